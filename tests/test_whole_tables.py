"""Registered queries over small tables that a filter, a cap or a prefix would show in."""

from collections import defaultdict

from tessera.operators import graph
from tessera.plans import catalog


def rows(spark, folder, query, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return sorted(tuple(r) for r in catalog.queries()[query](spark, str(folder)).collect())


def test_ownership_conflicts_of_all_lines(spark, tmp_path):
    lines = [(o, p, float(q)) for o, p, q in [(1, 10, 1), (1, 11, 50), (2, 10, 50), (4, 10, 45), (4, 11, 2), (4, 11, 46), (7, 9, 50), (7, 10, 3), (9, 8, 1)]]
    owned = defaultdict(set)
    for o, p, _ in lines:
        owned[o].add(str(p))
    want = [(a, b, ", ".join(sorted(owned[a] & owned[b]))) for a in owned for b in owned if a < b and b != a + 1 and owned[a] & owned[b]]
    assert rows(spark, tmp_path, "ownership_conflicts", lineitem=(lines, "l_orderkey long, l_partkey long, l_quantity double")) == sorted(want)


def test_oversample_into_all_documents(spark, tmp_path):
    docs, labels = ([(i,) for i in range(10)], "doc_id long"), ([(i, i % 4) for i in range(10)], "doc_id long, quality int")
    assert rows(spark, tmp_path, "oversample_seed_union", documents=docs, labels=labels) == [(i, 1 + 2 * (i % 4 == 1)) for i in range(10)]


def test_macro_mean_of_all_events(spark, tmp_path):
    events = [(0, "a", 90.0), (1, "a", 10.0), (2, "b", 90.0), (3, "b", 80.0), (5, "c", 10.0)]
    assert rows(spark, tmp_path, "macro_mean", events=(events, "event_id long, event_type string, value double")) == [(0.5,)]
    parts = [(0, "a", 90.0), (2, "a", 10.0), (1, "a", 90.0), (3, "a", 80.0)]
    assert rows(spark, tmp_path, "share_of_ref", events=(parts, "event_id long, event_type string, value double")) == [("a", 0.5)]


def test_layers_of_all_suppliers(spark, tmp_path):
    suppliers = ([(0, 10.0), (0, 20.0), (1, 5.0), (3, 100.0)], "s_nationkey int, s_acctbal double")
    got = rows(spark, tmp_path, "layer_fill_missing", supplier=suppliers, nation=([(k,) for k in range(5)], "n_nationkey int"))
    assert got == [(0, 15.0), (1, 5.0), (2, 40.0), (3, 100.0), (4, 40.0)]


def test_masked_examples_up_to_2048(spark, tmp_path):
    texts = [" ".join("x" * (i % 7 + 1) for i in range(n)) for n in (3, 8, 9, 13, 2048, 2049, 5000)]
    got = rows(spark, tmp_path, "masked_examples", benchmark=(list(enumerate(texts)), "item_id long, text string"))
    want = []
    for k, s in enumerate(texts):
        labels = ([-100] * len(s.split(" ")[:8]) + [len(w) for w in s.split(" ")[8:]])[:2048]
        want.append((k, len(labels), ",".join(map(str, labels)), any(x != -100 for x in labels[1:])))
    assert got == want


def test_cycle_paths_of_long_cycles(spark):
    ids = [f"t{k:03}" for k in range(70)]
    edge = spark.createDataFrame([*zip(ids, ids[1:] + ids[:1], strict=True), ("x", "t000"), ("y", "z"), ("z", "y")], "id string, dep string")
    assert sorted(r["path"] for r in graph.cycle_paths(edge).collect()) == [[*ids, "t000"], ["y", "z", "y"]]
