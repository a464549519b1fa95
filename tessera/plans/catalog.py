"""The registered queries over the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsontext, scoring, text
from ..operators import answers, curation, evaluation, events, execution, graph, models
from ..sources import files
from ..streaming import logs

SEED = "13"
#: SQL twins of expressions.
KEY = "substr(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), 1, 160)"
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark, sf, name):
    return files.parquet_table(spark, sf, name)


# ---- curation

@query(f"SELECT doc_id, lang, {KEY.format('text')} AS norm_key FROM (SELECT *, row_number() OVER (PARTITION BY {KEY.format('text')} ORDER BY doc_id) AS n FROM documents WHERE length(text) <= 6000) WHERE n = 1")
def norm_dedupe_documents(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "lang", "text")
    return curation.dedupe_inputs(docs, keep=["doc_id", "lang"]).select("doc_id", "lang", "norm_key")


@query("""SELECT lang, reason, count(*) AS n FROM (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 'truncated' WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) > 6000 THEN 'too_long' ELSE 'kept' END AS reason FROM documents) GROUP BY ALL""")
def drop_reason_counts(spark, sf):
    docs = t(spark, sf, "documents")
    checked = curation.check_answer(F.col("text"), F.col("doc_id") % 7 != 0, F.lit(False), F.lit(False))["reason"]
    reason = F.when(checked != "", checked).when(F.length("text") > 6000, "too_long").otherwise("kept")
    return docs.groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE {KEY.format('text')} NOT IN (SELECT {KEY.format('text')} FROM benchmark)")
def seen_anti_join(spark, sf):
    docs, seen = t(spark, sf, "documents"), t(spark, sf, "benchmark")
    return curation.unseen(docs, text.norm_key(F.col("text")), seen, text.norm_key(F.col("text"))).select("doc_id")


@query(f"SELECT norm_key, min(doc_id) AS first_seen FROM (SELECT {KEY.format('text')} AS norm_key, doc_id FROM documents) GROUP BY norm_key")
def ordered_distinct_keys(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", text.norm_key(F.col("text")).alias("norm_key"))
    return curation.ordered_distinct(docs, "norm_key", "doc_id")


@query(f"""SELECT doc_id, source, CASE WHEN r <= least(10, n // 5) THEN 'heldout' WHEN r <= least(10, n // 5) + 20 THEN 'train' ELSE 'unused' END AS part
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def hash_split(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source")
    return curation.hash_split(docs, "doc_id", SEED, 10, 20, ["source"]).select("doc_id", "source", "part")


_PARTS = f"""SELECT doc_id, CASE WHEN r <= least(10, n // 5) THEN 'heldout' WHEN r <= least(10, n // 5) + 20 THEN 'train' END AS part
FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)"""


@query(f"WITH p AS ({_PARTS}) SELECT (SELECT count(*) FROM (SELECT doc_id FROM p WHERE part = 'train' INTERSECT SELECT doc_id FROM p WHERE part = 'heldout')) AS shared, count(*) FILTER (WHERE part = 'train') AS train, count(*) FILTER (WHERE part = 'heldout') AS heldout FROM p")
def split_disjoint(spark, sf):
    rows = hash_split(spark, sf)
    train, held = (rows.where(F.col("part") == p).select("doc_id") for p in ("train", "heldout"))
    sizes = rows.agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "heldout").alias("heldout"))
    return train.intersect(held).agg(F.count("*").alias("shared")).crossJoin(sizes)


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id")
def oversample_seed_union(spark, sf):
    train = t(spark, sf, "documents").select("doc_id")
    seeds = t(spark, sf, "labels").where("quality = 1").select("doc_id")
    return curation.oversample(train, seeds).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT source, doc_id, shot FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}' || doc_id), doc_id) AS shot FROM documents) WHERE shot <= 3")
def few_shot_sample(spark, sf):
    return curation.few_shot(t(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", SEED).select("source", "doc_id", "shot")


@query("SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id")
def chat_rows_in_order(spark, sf):
    rows = curation.chat_rows(t(spark, sf, "conversations"))
    return rows.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"))


@query("""SELECT conv_id, n FROM (SELECT conv_id, count(*) AS n, arg_max(role, (turn, role, text)) AS last FROM conversations WHERE text <> '' GROUP BY conv_id) WHERE n >= 2 AND last = 'assistant'""")
def chat_valid_filter(spark, sf):
    rows = curation.chat_rows(t(spark, sf, "conversations"))
    rows = rows.withColumn("kept", curation.to_messages(rows.columns)).where("kept is not null")
    return rows.select("conv_id", F.size("kept").cast("long").alias("n"))


@query("""SELECT conv_id, turn, prompt, response FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def prompt_response_pairs(spark, sf):
    return curation.prompt_response_pairs(t(spark, sf, "conversations"))


@query("SELECT item_id, cut, labels, bears_loss FROM (SELECT item_id, least(2048, len(p) + len(r)) AS cut, array_to_string(list_slice(list_transform(p, lambda x: -100) || list_transform(r, lambda x: CAST(length(x) AS INT)), 1, 2048), ',') AS labels, least(len(p) + len(r), 2048) > greatest(len(p), 1) AS bears_loss FROM (SELECT item_id, list_slice(w, 1, 8) AS p, list_slice(w, 9, len(w)) AS r FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)))")
def masked_examples(spark, sf):
    words = F.split("text", " ")
    ids = F.transform(words, lambda w: F.length(w))
    rows = t(spark, sf, "benchmark").select("item_id", curation.mask_prompt(F.slice(ids, 1, 8), F.slice(ids, 9, F.size(ids)), 2048).alias("e"))
    return rows.select("item_id", F.size("e.input_ids").cast("long").alias("cut"), F.array_join(F.transform("e.labels", lambda x: x.cast("string")), ",").alias("labels"), curation.bears_loss(F.col("e.labels")).alias("bears_loss"))


# ---- text and JSON

@query("""SELECT page_id, html_tags, approx_tokens, slug FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-z]+')) AS BIGINT) AS html_tags, CAST(length(html) // 4 AS BIGINT) AS approx_tokens, regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM pages)""")
def page_shapes(spark, sf):
    tags = F.size(F.regexp_extract_all("html", F.lit("(<[a-z]+)"), F.lit(1))).cast("long")
    return t(spark, sf, "pages").select("page_id", tags.alias("html_tags"), text.approx_tokens(F.col("html")).alias("approx_tokens"), text.slug(F.col("url")).alias("slug"))


@query("""SELECT page_id, arg_max(v, (length(v), -i)) AS longest FROM (SELECT page_id, unnest(b) AS v, generate_subscripts(b, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages)) GROUP BY page_id""")
def longest_fence_block(spark, sf):
    blocks = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    return t(spark, sf, "pages").select("page_id", text.longest(blocks).alias("longest")).where("longest is not null")


@query("SELECT event_id, k, CASE WHEN k IS NULL THEN 'missing' WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def json_props_validate(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t(spark, sf, "events").select("event_id", k.alias("k")).withColumn("kind", F.when(F.col("k").isNull(), "missing").when(F.col("k") % 2 == 0, "even").otherwise("odd"))


@query("""SELECT a.event_id, 'k' AS field, json_extract_string(a.props, '$.k') AS expected, json_extract_string(b.props, '$.k') AS found, coalesce(json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k'), false) AS same
FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE json_extract_string(a.props, '$.k') IS NOT NULL""")
def field_diff(spark, sf):
    e = t(spark, sf, "events").select("event_id", "props")
    both = e.join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("next_props")), "event_id")
    return evaluation.field_diff(both, "props", "next_props", "event_id")


_TEMPLATE = "CASE doc_id % 5 WHEN 0 THEN '<|turn>' || lang WHEN 1 THEN 'x<start_of_turn>' WHEN 2 THEN '<|im_start|>' WHEN 3 THEN source ELSE '' END"
_MODEL = "CASE length(source) % 3 WHEN 0 THEN 'Gemma-4-' WHEN 1 THEN 'a-gemma-' ELSE 'b-' END || source"


@query(f"""SELECT family, count(*) AS n FROM (SELECT CASE WHEN t LIKE '%<|turn>%' THEN 'gemma4' WHEN t LIKE '%<start_of_turn>%' THEN 'gemma3' WHEN t LIKE '%<|im_start|>%' THEN 'chatml' WHEN t <> '' THEN NULL
WHEN m ILIKE '%gemma-4%' OR m ILIKE '%gemma4%' THEN 'gemma4' WHEN m ILIKE '%gemma%' THEN 'gemma3' ELSE 'chatml' END AS family FROM (SELECT {_TEMPLATE} AS t, {_MODEL} AS m FROM documents)) GROUP BY family""")
def template_families(spark, sf):
    named = t(spark, sf, "documents").select(F.expr(_TEMPLATE).alias("t"), F.expr(_MODEL).alias("m"))
    return named.groupBy(text.template_family(F.col("t"), F.col("m")).alias("family")).agg(F.count("*").alias("n"))


# ---- scores

@query("""WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), a AS (SELECT id, w, count(*) AS n FROM tok GROUP BY ALL), an AS (SELECT id, sum(n) AS s FROM a GROUP BY id),
bt AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), b AS (SELECT id, w, count(*) AS n FROM bt GROUP BY ALL), bn AS (SELECT id, sum(n) AS s FROM b GROUP BY id),
c AS (SELECT a.id AS doc_id, b.id AS item_id, sum(least(a.n, b.n)) AS common FROM a JOIN b USING (w) GROUP BY ALL),
f AS (SELECT doc_id, item_id, 2.0 * common / (an.s + bn.s) AS f1 FROM c JOIN an ON an.id = doc_id JOIN bn ON bn.id = item_id)
SELECT doc_id, item_id, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(f1, 6) DESC, item_id) AS r FROM f) WHERE r = 1""")
def benchmark_overlap_f1(spark, sf):
    return scoring.best_overlap(t(spark, sf, "documents"), t(spark, sf, "benchmark"), "doc_id", "item_id")


@query("""WITH p AS (SELECT event_type AS suite, user_id AS id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE value > 50) AS INT) AS c FROM events GROUP BY ALL)
SELECT suite, count(*) AS problems, round(avg(c / n), 4) AS pass_at_1, round(avg(CASE WHEN n < 2 THEN NULL WHEN n - c < 2 THEN 1.0 ELSE 1 - ((n - c) * (n - c - 1.0)) / (n * (n - 1.0)) END), 4) AS pass_at_2 FROM p GROUP BY suite""")
def pass_at_k_by_type(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("suite"), F.col("user_id").alias("id"), (F.col("value") > 50).alias("passed"))
    p = evaluation.per_problem(e)
    k = lambda k: F.round(F.avg(F.when(F.col("n") >= k, scoring.pass_at_k(F.col("n"), F.col("c"), k))), 4).alias(f"pass_at_{k}")
    return p.groupBy("suite").agg(F.count("*").alias("problems"), k(1), k(2))


_RATES = "SELECT event_type AS suite, round(avg(CAST(value > 50 AS INT)), 4) AS pass_at_1 FROM events WHERE event_id % 2 = {0} GROUP BY ALL"


def _rates(spark, sf, part=None):
    e = t(spark, sf, "events")
    return (e if part is None else e.where(F.col("event_id") % 2 == part)).groupBy(F.col("event_type").alias("suite")).agg(F.round(F.avg((F.col("value") > 50).cast("int")), 4).alias("pass_at_1"))


@query(f"SELECT a.suite, round(a.pass_at_1 / b.pass_at_1, 4) AS share FROM ({_RATES.format(0)}) a JOIN ({_RATES.format(1)}) b USING (suite) WHERE b.pass_at_1 <> 0")
def share_of_ref(spark, sf):
    return evaluation.share_of_ref(_rates(spark, sf, 0), _rates(spark, sf, 1))


@query("SELECT round(avg(pass_at_1), 4) AS mean_pass_at_1 FROM (SELECT round(avg(CAST(value > 50 AS INT)), 4) AS pass_at_1 FROM events GROUP BY event_type)")
def macro_mean(spark, sf):
    return evaluation.macro_mean(_rates(spark, sf))


@query("""SELECT event_type AS suite, CASE WHEN value > 50 THEN 'pass' WHEN value > 25 THEN 'timeout' ELSE 'test_failed' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def status_histogram(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("suite"), (F.col("value") > 50).alias("passed"), F.when(F.col("value") > 25, "timeout").otherwise("").alias("reason"))
    return evaluation.status_counts(e)


@query("""WITH c AS (SELECT s_suppkey AS name, round(s_acctbal, 2) AS score, s_acctbal <= 5000 AND s_nationkey >= 5 AS fits FROM supplier), a AS (SELECT * FROM c WHERE fits OR NOT (SELECT bool_or(fits) FROM c))
SELECT name, score FROM a ORDER BY CAST(name = 7 AND score >= (SELECT max(score) FROM a) - 0.02 AS INT) DESC, score DESC, name LIMIT 1""")
def winner_selection(spark, sf):
    c = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), F.round("s_acctbal", 2).alias("score"), evaluation.meets_target(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), 5000, 5).alias("meets_target"))
    return evaluation.winner(c, "score", "name", F.col("name") == 7).select("name", "score")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark, sf):
    top = evaluation.top_k(t(spark, sf, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 3)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_partkey, round(sum(l_discount * l_quantity) / greatest(count(*), 1) + 1e-9, 6) AS saliency, count(*) AS freq FROM lineitem GROUP BY l_partkey")
def saliency_mean(spark, sf):
    s = evaluation.saliency(t(spark, sf, "lineitem"), ["l_partkey"], "l_discount", "l_quantity")
    return s.select("l_partkey", F.round(F.col("saliency") + 1e-9, 6).alias("saliency"), "freq")


@query("""WITH a AS (SELECT l_suppkey, avg(l_discount) AS i, sum(l_quantity) AS e FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, i / avg(i) OVER () AS i, e / avg(e) OVER () AS e FROM a), c AS (SELECT l_suppkey, i * pow(e, 0.25) AS raw FROM b)
SELECT l_suppkey, round(least(4.0, greatest(0.25, raw / avg(raw) OVER ())), 6) AS sensitivity FROM c""")
def normalise_clip(spark, sf):
    a = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("i"), F.sum("l_quantity").alias("e"))
    return evaluation.sensitivities(a, "i", "e").select("l_suppkey", F.round("sensitivity", 6).alias("sensitivity"))


@query("""WITH m AS (SELECT s_nationkey AS layer, avg(s_acctbal) AS x FROM supplier GROUP BY ALL) SELECT n_nationkey AS layer, round(coalesce(x, (SELECT avg(x) FROM m)), 4) AS x FROM nation LEFT JOIN m ON layer = n_nationkey""")
def layer_fill_missing(spark, sf):
    m = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("layer")).agg(F.avg("s_acctbal").alias("x"))
    layers = t(spark, sf, "nation").select(F.col("n_nationkey").alias("layer"))
    return evaluation.fill_layers(m, layers, "layer", "x").select("layer", F.round("x", 4).alias("x"))


@query("SELECT lang, n, round(n / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 4)")
def label_histogram_top4(spark, sf):
    return evaluation.shares(t(spark, sf, "documents").select("lang"), "lang").select("lang", "n", F.round("share", 6).alias("share"))


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY ALL""")
def candidate_suite_pivot(spark, sf):
    return evaluation.matrix(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.round(F.avg("o_totalprice"), 2))


@query("SELECT l_returnflag, median(l_extendedprice) AS median_speed FROM lineitem GROUP BY ALL")
def median_speed(spark, sf):
    return evaluation.exact_median(t(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice").withColumnRenamed("median", "median_speed")


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal > 5000 AS big, s_nationkey < 5 AS slow FROM supplier) SELECT id, concat_ws(', ', CASE WHEN big THEN 'too large' END, CASE WHEN slow THEN 'too slow' END) AS missed FROM s WHERE big OR slow""")
def target_misses(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), evaluation.missed(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), 5000, 5).alias("missed"))
    return s.where("missed <> ''")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND m.n_nationkey IS NOT NULL THEN 'exactly ' || m.n_name ELSE coalesce(n.n_name, 'none') END AS target FROM orders LEFT JOIN nation n ON n.n_nationkey = o_custkey % 40 LEFT JOIN nation m ON m.n_nationkey = o_custkey % 40 AND m.n_regionkey = 1")
def model_route(spark, sf):
    name = F.concat((F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "@1").otherwise("@2"))
    ask = t(spark, sf, "orders").select("o_orderkey", name.alias("model"))
    n = t(spark, sf, "nation").withColumn("name", F.col("n_nationkey").cast("string"))
    exact = n.where("n_regionkey = 1").select(F.concat("name", F.lit("@1")).alias("name"), F.concat(F.lit("exactly "), "n_name").alias("target"))
    routes = n.select("name", F.col("n_name").alias("target")).unionByName(exact)
    return evaluation.model_route(ask, routes, "model", "none").select("o_orderkey", "target")


# ---- events

@query("""WITH m AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS last FROM events GROUP BY ALL) SELECT event_id, user_id FROM events JOIN m USING (user_id) WHERE event_id >= coalesce(last, -1)""")
def latest_run_slice(spark, sf):
    return events.latest_run(t(spark, sf, "events"), F.col("event_type") == "signup", "event_id", ["user_id"]).select("event_id", "user_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_event_per_key(spark, sf):
    return events.last_per_key(t(spark, sf, "events"), ["user_id", "event_type"], "event_id", ["event_id", "value"])


_AS_STATUS = "CASE WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'done' END"


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS u, {_AS_STATUS} AS status FROM events), m AS (SELECT *, status = 'running' AND coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id), '') <> 'running' AS opens FROM e),
a AS (SELECT user_id, max(u) FILTER (WHERE opens) AS started, max(u) FILTER (WHERE status <> 'running') AS ended FROM m GROUP BY ALL) SELECT user_id, started, ended, CASE WHEN ended >= started THEN ended - started END AS seconds FROM a""")
def stage_durations(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type").isin("click", "view"), "running").otherwise("done").alias("status"))
    return events.stage_times(e, ["user_id"], "event_id", "at")


@query("""WITH s AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events GROUP BY user_id), m AS (SELECT a AS u, 1 AS d FROM s UNION ALL SELECT b, -1 FROM s), g AS (SELECT u, sum(d) AS d FROM m GROUP BY u)
SELECT CAST(max(level) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY u) AS level FROM g)""")
def peak_concurrency(spark, sf):
    s = t(spark, sf, "events").groupBy("user_id").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b"))
    return events.peak_concurrency(s, "a", "b")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), n AS (SELECT *, sum(CAST(length(line) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS segment FROM l),
g AS (SELECT doc_id, segment, string_agg(line, chr(10) ORDER BY i) AS text, max(segment) OVER (PARTITION BY doc_id) AS last FROM n WHERE segment > 0 GROUP BY doc_id, segment)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, CAST(length(text) AS BIGINT) AS chars FROM g WHERE segment < last AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 20""")
def article_segments(spark, sf):
    lines = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    seg = events.segments(lines, ["doc_id"], "i", F.length("line") < 40, words=20)
    return seg.select("doc_id", F.col("segment").cast("long").alias("segment"), F.length("text").cast("long").alias("chars"))


@query("""SELECT event_id, CASE WHEN n = 1 THEN event_type || '.c' ELSE event_type || '_' || n || '.c' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)""")
def numbered_names(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.concat("event_type", F.lit(".c")).alias("name"))
    return events.number_names(e, ["user_id"], "name", "event_id").select("event_id", "unique_name")


@query("""WITH a AS (SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last FROM events GROUP BY ALL), s AS (SELECT *, CASE last WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'failed' ELSE 'skipped' END AS state FROM a),
t AS (SELECT count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'done' AND attempts = 1) AS first_try FROM s)
SELECT *, (SELECT count(*) FROM events) AS calls, round(first_try / greatest(1, done), 6) AS first_try_share FROM t""")
def run_summary(spark, sf):
    e = t(spark, sf, "events")
    last = F.max_by("event_type", "event_id")
    s = e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.when(last == "purchase", "done").when(last == "click", "failed").otherwise("skipped").alias("state"))
    out = events.run_summary(s, e.select(F.lit(1).alias("tokens"), F.lit(1).alias("ms")))
    return out.select("done", "failed", "skipped", "first_try", "calls", F.round("first_try_share", 6).alias("first_try_share"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(value * CASE WHEN i = 1 THEN 1 ELSE 0.1 END * pow(0.9, n - i)), 6) AS ema FROM o GROUP BY ALL""")
def ema_loss(spark, sf):
    return evaluation.moving_loss(t(spark, sf, "events"), "event_type", "event_id", "value").select("event_type", F.round("ema", 6).alias("ema"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    out = t(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH a AS (SELECT user_id, ts, CAST(ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS started, count(*) AS n FROM b GROUP BY user_id, s""")
def session_windows(spark, sf):
    s = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    out = t(spark, sf, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n")


# ---- graphs: a supplier depends on its nation, a nation on its region; an order owns the parts of its lines

_EDGES = "SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS dep FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def _edges(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = t(spark, sf, "supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("dep"))
    return s.unionByName(t(spark, sf, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("dep")))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(id, anc) AS (SELECT id, dep FROM e UNION SELECT r.id, e.dep FROM r JOIN e ON r.anc = e.id) SELECT id, anc FROM r")
def dag_ancestors(spark, sf):
    return graph.ancestors(_edges(spark, sf))


@query(f"WITH e AS ({_EDGES}), f AS (SELECT id FROM e WHERE id LIKE 'n%' AND dep IN ('r1', 'r2') AND id <> 'n7'), s AS (SELECT id FROM e WHERE dep IN (SELECT id FROM f)) SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT id FROM f)")
def skip_propagation(spark, sf):
    e = _edges(spark, sf)
    failed = e.where("id like 'n%' and dep in ('r1', 'r2') and id <> 'n7'").select("id")
    return graph.skipped(graph.ancestors(e), failed)


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem) SELECT a.id AS a, b.id AS b, string_agg(CAST(a.p AS VARCHAR), ', ' ORDER BY CAST(a.p AS VARCHAR)) AS shared FROM o a JOIN o b ON a.p = b.p AND a.id < b.id
WHERE NOT (b.id = a.id + 1) GROUP BY ALL""")
def ownership_conflicts(spark, sf):
    l = t(spark, sf, "lineitem")
    owned = l.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("path"))
    chain = owned.select("id").distinct().select(F.col("id"), (F.col("id") - 1).alias("anc"))
    return graph.ownership_conflicts(owned, chain)


@query(f"WITH e AS ({_EDGES}) SELECT id, dep FROM e WHERE dep NOT IN (SELECT id FROM e)")
def unknown_dependencies(spark, sf):
    e = _edges(spark, sf)
    return graph.unknown_dependencies(e.groupBy("id").agg(F.collect_list("dep").alias("depends_on")))


@query("""SELECT s_suppkey, rule FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey NOT BETWEEN 1 AND 20 THEN 'nation' END], lambda x: x IS NOT NULL)) AS rule FROM supplier)""")
def rule_violations(spark, sf):
    return graph.violations(t(spark, sf, "supplier"), "s_suppkey", {"balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey").between(1, 20)})


@query("SELECT url, regexp_matches(url, '^https?://[^/]*/.*1.*$') AS hit, NOT (url = '' OR url LIKE '/%' OR contains(url, chr(92)) OR regexp_matches(url, '[*?\\[\\]]') OR len(list_filter(string_split(url, '/'), lambda x: x IN ('', '.', '..'))) > 0 OR string_split(url, '/')[1] = '.git') AS safe FROM pages")
def glob_and_paths(spark, sf):
    p = t(spark, sf, "pages")
    pattern = F.replace(text.glob_pattern(F.lit("http?://*/**1**")), F.lit("http[^/]"), F.lit("https?"))
    return p.select("url", F.regexp_like("url", pattern).alias("hit"), text.safe_path(F.col("url")).alias("safe"))


# ---- the reference's own functions over the tables, each against SQL of its own

_ANSWER = "'Well:' || chr(10) || '```c.h' || chr(10) || '  ' || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```py' || chr(10) || source || chr(10) || '```'"
_BLOCKS = "list_reduce(regexp_extract_all(a, '(?s)```{0}[ \\t]*\\n(.*?)```', 1), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)"


@query(f"""SELECT doc_id, md5(regexp_replace({_BLOCKS.format("[\\w+#.-]*")}, '\\s+$', '')) AS program, md5(regexp_replace({_BLOCKS.format("[\\w+#-]*")}, '^\\s+|\\s+$', '', 'g')) AS code
FROM (SELECT doc_id, {_ANSWER} AS a FROM documents WHERE text IS NOT NULL)""")
def fenced_programs(spark, sf):
    answers = t(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(_ANSWER.replace("chr(10)", "'\\n'")).alias("a"))
    return answers.select("doc_id", F.md5(text.program_of(F.col("a"))).alias("program"), F.md5(text.code_of(F.col("a"))).alias("code"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || props || ' there.' WHEN 2 THEN 'So' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' ELSE '[' || props || ']' END"


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS whole,
CASE WHEN event_id % 4 IN (0, 2) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS fenced, event_id % 4 IN (0, 3) AND (props LIKE '{%' OR event_id % 4 = 3) AS looks, event_id % 4 <> 1 AS parses FROM events""")
def json_replies(spark, sf):
    reply = F.expr(_REPLY.replace("chr(10)", "'\\n'"))
    e = t(spark, sf, "events").select("event_id", reply.alias("r"))
    k = lambda v: F.try_variant_get(v, "$.k", "long")
    first = F.when(F.col("event_id") % 4 != 3, k(jsontext.first_object(F.col("r"))))
    return e.select("event_id", first.alias("whole"), k(jsontext.as_json(F.col("r"))).alias("fenced"), text.looks_like_json(F.col("r")).alias("looks"), jsontext.as_json(F.col("r")).isNotNull().alias("parses"))


_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, {_TOKENS.format("text")} AS a, {_TOKENS.format("answer")} AS b FROM c WHERE role = 'user' AND next_role = 'assistant'),
m AS (SELECT conv_id, turn, sum(least(x, y)) AS common FROM (SELECT conv_id, turn, w, count(*) FILTER (WHERE s = 0) AS x, count(*) FILTER (WHERE s = 1) AS y FROM (SELECT conv_id, turn, unnest(a) AS w, 0 AS s FROM p UNION ALL SELECT conv_id, turn, unnest(b), 1 FROM p) GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * common / (len(a) + len(b)) END, 6) AS f1 FROM p LEFT JOIN m USING (conv_id, turn)""")
def pair_f1(spark, sf):
    pairs = curation.prompt_response_pairs(t(spark, sf, "conversations"))
    return pairs.select("conv_id", "turn", F.round(scoring.token_f1(F.col("prompt"), F.col("response")), 6).alias("f1"))


_RESULTS = "SELECT event_type AS suite, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'c' ELSE 'python' END AS language, CAST(user_id AS VARCHAR) AS id, event_type <> 'view' AND value > 50 AS passed, CASE WHEN event_type = 'view' THEN CASE WHEN value > 25 THEN 'missing_toolchain' ELSE 'unsupported_language' END WHEN value > 25 THEN 'timeout' ELSE '' END AS reason FROM events"


@query(f"""WITH r AS ({_RESULTS}), s AS (SELECT *, CASE WHEN passed THEN 'pass' WHEN reason = '' THEN 'test_failed' ELSE reason END AS status FROM r),
h AS (SELECT suite, string_agg(status || '=' || n, ',' ORDER BY status) AS status, string_agg(status, ', ' ORDER BY status) AS reasons, bool_and(status IN ('missing_toolchain', 'unsupported_language')) AS none FROM (SELECT suite, status, count(*) AS n FROM s GROUP BY ALL) GROUP BY suite),
p AS (SELECT suite, count(*) AS problems, round(avg(c), 4) AS pass_at_1 FROM (SELECT suite, id, avg(CAST(passed AS INT)) AS c FROM r GROUP BY ALL) GROUP BY suite),
l AS (SELECT suite, CASE WHEN min(language) = max(language) THEN min(language) ELSE 'mixed' END AS language FROM r GROUP BY suite)
SELECT suite, language, problems, status, CASE WHEN none THEN reasons END AS skipped, CASE WHEN NOT none THEN pass_at_1 END AS pass_at_1 FROM h JOIN p USING (suite) JOIN l USING (suite)""")
def suite_summary(spark, sf):
    s = evaluation.summarize(t(spark, sf, "events").selectExpr(*_selected(_RESULTS)), [1])
    status = F.array_join(F.transform(F.map_entries("status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.withColumn("status", status)


def _selected(sql: str) -> list[str]:
    """The expressions of a plain SELECT of one table, for Spark's parser."""
    body, out, depth = sql[len("SELECT ") : sql.rindex(" FROM ")].replace("VARCHAR", "STRING"), [""], 0
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


@query(f"WITH r AS ({_RESULTS}) SELECT coalesce(round(avg(CAST(passed AS INT)), 3), 0.0) AS pass_rate FROM r")
def sandbox_pass_rate(spark, sf):
    return evaluation.pass_rate(t(spark, sf, "events").selectExpr(*_selected(_RESULTS)))


@query("SELECT round(avg(value / 100), 3) AS agreement, round(avg(CASE WHEN event_type <> 'view' THEN value / 200 END), 3) AS judge FROM events")
def mean_agreement(spark, sf):
    return evaluation.mean_scores(t(spark, sf, "events").select((F.col("value") / 100).alias("agreement"), F.when(F.col("event_type") != "view", F.col("value") / 200).alias("judge")))


@query("""SELECT s_nationkey AS race, CASE WHEN bool_and(s_acctbal > 0) THEN 'pass_at_1' WHEN bool_and(s_suppkey % 7 <> 0) THEN 'judge_score' ELSE 'agreement' END AS method FROM supplier GROUP BY ALL""")
def score_methods(spark, sf):
    c = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("race"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("pass_at_1"), F.when(F.col("s_suppkey") % 7 != 0, F.lit(0.5)).alias("judge_score"))
    return evaluation.score_method(c, ["race"])


_PLAN = "SELECT 'n' || n_nationkey AS id, n_regionkey + 1 AS priority, CASE WHEN n_nationkey % 6 = 5 THEN 'done' WHEN n_nationkey % 6 = 0 THEN 'running' ELSE 'waiting' END AS state, 'n' || (n_nationkey * 5 + 3) % 25 AS dep, 'f' || n_nationkey // 2 AS path FROM nation"


@query(f"""WITH t AS ({_PLAN}), w AS (SELECT * FROM t WHERE state = 'waiting' AND dep IN (SELECT id FROM t WHERE state = 'done') AND path NOT IN (SELECT path FROM t WHERE state = 'running')),
f AS (SELECT id, priority FROM w WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.path = w.path AND (x.priority, x.id) < (w.priority, w.id)))
SELECT id, priority FROM (SELECT *, row_number() OVER (ORDER BY priority, id) AS r FROM f) WHERE r <= 8 - (SELECT count(*) FROM t WHERE state = 'running')""")
def ready_tickets(spark, sf):
    plan = t(spark, sf, "nation").selectExpr(*_selected(_PLAN.replace("//", "div"))).cache()
    tickets = plan.select("id", "priority", F.array("dep").alias("depends_on"), F.array("path").alias("owns"))
    return graph.ready(tickets, plan.select("id", "state"), 8)


_RING = "SELECT n_nationkey AS id, (n_nationkey * 7 + 2) % 25 AS dep FROM nation"


@query(f"""WITH RECURSIVE e AS ({_RING}), w(first, here, path) AS (SELECT id, dep, [id, dep] FROM e UNION ALL SELECT first, dep, list_append(path, dep) FROM w JOIN e ON e.id = w.here WHERE here <> first AND len(path) <= 25),
c AS (SELECT first, path FROM w WHERE here = first) SELECT array_to_string(path, '>') AS path FROM c WHERE first = list_min(path)""")
def cycles(spark, sf):
    e = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 7 + 2) % 25).alias("dep"))
    return graph.cycle_paths(e).select(F.array_join("path", ">").alias("path"))


@query("""SELECT layer, kind, round(sum(list_sum(list_transform(v, lambda x: x * x * abs(x)))), 6) AS energy FROM (SELECT vec_id % 12 AS layer, CASE WHEN label % 2 = 0 THEN 'down' ELSE 'gate' END AS kind, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL) GROUP BY ALL""")
def tensor_energy(spark, sf):
    v = t(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    name = F.concat(F.lit("blk."), F.col("vec_id").cast("string"))
    tensors = v.select(name.alias("name"), (F.col("vec_id") % 12).alias("layer"), F.when(F.col("label") % 2 == 0, "down").otherwise("gate").alias("kind"), F.transform("v", lambda x: F.abs(x)).alias("col_sq"))
    sums = v.select(F.concat(name, F.lit(".in_sum2")).alias("name"), F.transform("v", lambda x: x * x).alias("in_sum2"))
    return models.energy(tensors, sums).select("layer", "kind", F.round("energy", 6).alias("energy"))


@query("SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_name END AS b, CASE WHEN c_nationkey < 5 THEN 'near' END AS c FROM customer")
def settings_overlay(spark, sf):
    c = t(spark, sf, "customer")
    maps = [F.create_map(F.lit("a"), "c_mktsegment", F.lit("b"), "c_name"), F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("b"), F.lit("low"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("c_nationkey") < 5, F.create_map(F.lit("c"), F.lit("near"))).otherwise(F.create_map().cast("map<string,string>"))]
    return c.select("c_custkey", evaluation.overlay(*maps).alias("m")).select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("""SELECT event_id, CASE WHEN ms < 1000 THEN CAST(floor(ms + 0.5) AS BIGINT) || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s % 3600 // 60) END AS took,
CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 10000 THEN printf('%.1fk', floor(n / 100 + 0.5) / 10) WHEN n < 1000000 THEN CAST(floor(n / 1000 + 0.5) AS BIGINT) || 'k' ELSE printf('%.1fM', floor(n / 100000 + 0.5) / 10) END AS tokens FROM (SELECT event_id, value * value * 700 AS ms, CAST(floor(value * value * 700 / 1000 + 0.5) AS BIGINT) AS s, CAST(floor(value * 20011.37) AS BIGINT) AS n FROM events)""")
def shown_figures(spark, sf):
    e = t(spark, sf, "events")
    ms, n = F.col("value") * F.col("value") * 700, F.floor(F.col("value") * 20011.37).cast("long")
    return e.select("event_id", text.milliseconds(ms).alias("took"), text.token_count(n).alias("tokens"))


@query("SELECT source, md5(string_agg(block, chr(10) ORDER BY doc_id)) AS pack FROM (SELECT source, doc_id, '--- ' || doc_id || chr(10) || substr(coalesce(text, ''), 1, 20000) || CASE WHEN length(coalesce(text, '')) > 20000 THEN chr(10) || '…(truncated)' ELSE '' END AS block FROM documents) GROUP BY source")
def file_blocks(spark, sf):
    d = t(spark, sf, "documents").select("source", "doc_id", text.file_block(F.col("doc_id").cast("string"), F.col("text")).alias("b"))
    packed = d.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "b"))).alias("r"))  # a prompt shows all of its files
    return packed.select("source", F.md5(F.array_join(F.transform("r", lambda x: x["b"]), "\n")).alias("pack"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN coalesce(n_name, 'queued') ELSE 'done' END AS state FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def job_listing(spark, sf):
    api = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("job"), F.when(F.col("s_acctbal") < 0, "queued").otherwise("done").alias("state"))
    disk = t(spark, sf, "nation").select(F.col("n_nationkey").alias("job"), F.col("n_name").alias("label"))
    return evaluation.status_listing(api, disk).select(F.col("job").alias("s_suppkey"), "state")


@query("(SELECT DISTINCT l_partkey AS value, 'two' AS missing_in FROM lineitem WHERE l_partkey NOT IN (SELECT ps FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem))) UNION ALL (SELECT DISTINCT l_suppkey, 'one' FROM lineitem WHERE l_suppkey NOT IN (SELECT l_partkey FROM lineitem))")
def only_on_one_side(spark, sf):
    l = t(spark, sf, "lineitem")
    return evaluation.difference(l.select("l_partkey"), l.select("l_suppkey"))


@query("SELECT a.event_id, a.user_id = b.user_id AS same FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) a JOIN (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS i FROM events) b USING (i)")
def zipped_by_place(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id")
    n, first = e.agg(F.count("*"), F.min("event_id")).first()
    place = e.withColumn("ord", F.col("event_id") - first + 1)  # event ids have no gaps
    back = place.select((n + 1 - F.col("ord")).alias("ord"), F.col("user_id").alias("other"))
    return evaluation.zipped(place, back).select("event_id", (F.col("user_id") == F.col("other")).alias("same"))


@query("""WITH j AS (SELECT user_id AS job, arg_max(event_type, event_id) AS last, max(event_id) AS n FROM events GROUP BY ALL) SELECT job, 'pipeline' AS stage, CASE WHEN job % 9 = 0 THEN 'stopped' ELSE 'error' END AS status, CASE WHEN job % 9 = 0 THEN 'stopped; resume to continue' ELSE 'exited with ' || job % 3 END AS msg, n + 1 AS seq FROM j WHERE job % 9 = 0 OR last <> 'purchase'""")
def closing_events(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("job"), F.when(F.col("event_type") == "purchase", "pipeline").otherwise("data").alias("stage"), F.lit("running").alias("status"), F.col("event_id").alias("seq"))
    exits = e.select("job").distinct().select("job", (F.col("job") % 3).alias("code"), (F.col("job") % 9 == 0).alias("stopped"))
    return logs.closing_event(e, exits)


@query("""SELECT regexp_extract(t, '\\bcandidate\\s*=\\s*([\\w:]+)', 1) AS entry, item_id, md5(regexp_replace(t, '^\\s*\\}', '')) AS tests FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '  }' || chr(10) ELSE '' END || 'auto candidate = ns::f' || item_id || ';' || chr(10) || text AS t FROM benchmark)""")
def completion_problems(spark, sf):
    b = t(spark, sf, "benchmark")
    tests = F.concat(F.when(F.col("item_id") % 2 == 0, "  }\n").otherwise(""), F.lit("auto candidate = ns::f"), F.col("item_id").cast("string"), F.lit(";\n"), "text")
    rows = answers.completion_problem(b.select(F.col("item_id").alias("name"), F.lit("int f() {").alias("prompt"), tests.alias("tests")), "cpp")
    return rows.select("entry", F.col("id").alias("item_id"), F.md5("tests_code").alias("tests"))


@query("""SELECT user_id AS "user", list_max(list_transform(l, lambda x: x // 4)) AS longest, len(l) AS seeds FROM (SELECT user_id, list(length(props)) AS l FROM events GROUP BY ALL)""")
def longest_seeds(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg(F.collect_list(F.struct(F.col("props").alias("output"))).alias("s"))  # a task's seeds
    return e.select("user", text.longest_seed_tokens(F.col("s")).alias("longest"), F.size("s").cast("long").alias("seeds"))


# ---- what SQL can't express

@query()
def length_batches(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))
    return execution.length_batches(docs, "doc_id", "n", 16384, 64)


@query()
def sandbox_pass_filter(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id", F.lit("python").alias("language"), F.length("text").alias("n"))
    code = text.with_tests(F.format_string("def f():\n    return %d", "n"), F.format_string("assert f() == %d", F.when(F.col("item_id") % 4 == 0, F.col("n") + 1).otherwise(F.col("n"))))
    return execution.run_tests(items.withColumn("code", code), "item_id", "language", "code").select("item_id", "passed", "reason")


@query()
def answer_agreement(spark, sf):
    e = t(spark, sf, "events").select("event_id", "props", F.lead("props").over(Window.partitionBy("user_id").orderBy("event_id")).alias("answer")).where("answer is not null")
    return e.select("event_id", scoring.agreement(F.col("answer"), F.col("props")).alias("agreement"), jsontext.same(F.col("answer"), F.col("props")).alias("same"))
