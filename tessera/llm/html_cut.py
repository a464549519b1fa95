"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier over a block's surroundings (structural tags,
words of class, id and role), links and length gives the probability that it is content; the costs of
either label are terminal capacities of a flow network. Neighbouring blocks, and blocks near each other
in the element tree, are joined by smoothness edges. The minimum cut (maximum flow, level graphs and
blocking flows) is the labelling of least total cost: a short block amid content stays content, and a
wordy one amid boilerplate does not.

Edge cases: a null or empty page has the empty text; markup that is not closed, closed twice or cut off
is read as browsers do, roughly; scripts, styles and other raw text are no text of the page, and neither is
what closed elements of HIDDEN hold; text outside any element is a block; other columns are kept by
extract(); rows repeat as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_STOP = re.compile(r"""[>"']""")
#: Elements whose text browsers read as raw up to the end tag, or the end of the page; it is not shown.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in "script style noscript iframe textarea title".split()}
#: Tags whose quotes may fail to close before quotes are no longer believed in; bounds the work on broken pages.
BROKEN = 4
#: Elements that show nothing of the markup inside, where they are closed.
HIDDEN = frozenset("template svg object canvas".split())
_NAMES = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that end a block of text; what opens in them closes with them.
CONTAINERS = frozenset("html body main article section nav header footer aside div form fieldset table thead tbody tfoot tr ul ol dl menu dialog figure details blockquote select button label".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr option summary figcaption caption legend address center optgroup".split())
#: Tags that end an svg that was not closed.
BREAKOUT = BREAKS | frozenset("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements and words of names that speak against content, and for it.
BAD_TAGS = frozenset("nav footer aside form menu dialog select button label fieldset head".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion promoted outbrain taboola "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sitemap skip toolbar tabs header masthead topbar logo footer foot bottom copyright legal "
    "sidebar side rail widget widgets related recommended recommendations more trending popular tags tagcloud "
    "notice notices cookie cookies consent gdpr alert warning disclaimer popup modal overlay subscribe subscription newsletter signup login signin register paywall "
    "form search social share sharing follow like comment comments commentlist disqus reply replies respond discussion feedback reviews".split()
)
GOOD_WORDS = frozenset("article articles content post entry story body main text maincontent articlebody blogpost".split())
#: Bad words that an article's own parts have in their names too; they don't speak against what is inside one.
SOFT_WORDS = frozenset("more notice notices alert warning disclaimer top bottom side tabs feedback discussion reviews legal".split())
#: Words of names that tell nothing of what is inside.
GENERIC = GOOD_WORDS | frozenset("area bar block box button buttons container group holder inner item items left line links list outer panel posts right row section slot this top unit wrap wrapper zone".split())
#: Names "has-sidebar" and "no-header" tell of the layout, not of what is inside.
_LAYOUT = re.compile(r"(?<![a-z])(?:has|no|not|with|without|hide|hides|show|shows)[-_]+[\w-]+")
#: An article in one of these, or in an element named only so or one of FIRM_WORDS, is a teaser or a comment; any other is content whatever holds it.
FIRM_TAGS = frozenset("nav footer aside menu dialog select button label".split())
FIRM_NAMES = frozenset("sidebar rail footer nav menu ads".split())
FIRM_WORDS = frozenset("comment comments commentlist disqus reply replies related recommended recommendations trending popular widget widgets outbrain taboola".split())
#: What is in a page-wide form, but not in one to fill in.
PAGE_PARTS = frozenset("article main nav header footer aside".split())
#: Weights of the classifier's inputs.
WEIGHTS = {"bias": -0.2, "bad": -6.0, "good": 3.2, "links": -3.5, "length": 0.9, "heading": 0.4, "sentence": 0.6, "list": -0.4}
#: What is added to the bias of a page without any block that stands out.
PRIOR = 3.0
#: Capacities of edges: between neighbours in page order, more in the same element, and in the same grandparent.
ADJACENT, SIBLING, COUSIN = 0.15, 0.9, 0.35
_SCALE = 1000


def markup(page: str, at: int = 0):
    """(start, end, tag, whether it is an end tag, attributes) of each piece of markup, raw text with its start tag, in one pass.

    A ">" in quotes does not end a tag unless the quotes never close. What no ">" follows is text.
    """
    last, broken = page.rfind(">"), 0
    while (start := page.find("<", at)) >= 0:
        if start > last and (start := page.find("<!--", start)) < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        m = _NAME.match(page, start)
        if not m:
            if page[start + 1] in "!?":
                at = page.index(">", start) + 1
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        end = -1
        if broken < BROKEN:
            stop = _STOP.search(page, m.end())
            while stop and stop[0] != ">":
                close = page.find(stop[0], stop.end())
                stop = _STOP.search(page, close + 1) if close >= 0 else None
            end = stop.start() if stop else -1
            broken += end < 0
        if end < 0:
            end = page.index(">", m.end())
        at = end + 1
        yield start, at, m[1].lower(), page[start + 1] == "/", page[m.end() : end]


def tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """markup() with raw text and what closed elements hide as one token each, without a tag as comments are."""
    out: list = []
    opened: dict[str, list[int]] = {x: [] for x in HIDDEN}
    hidden: dict[int, int] = {}
    at = 0
    while at < len(page):
        again = False
        for start, stop, tag, end, attrs in markup(page, at):
            if tag in BREAKOUT:
                opened["svg"].clear()
            if tag in RAW and not end and not (opened["svg"] and attrs.endswith("/")):
                m = RAW[tag].search(page, stop)
                close = page.find(">", m.end()) if m else -1
                stop, tag, again = close + 1 if close >= 0 else len(page), "", True  # markup is read on after it
            elif tag in HIDDEN:
                if end:
                    if opened[tag]:
                        hidden[opened[tag].pop()] = len(out)
                elif not (tag == "svg" and attrs.endswith("/")):
                    opened[tag].append(len(out))
            out.append((start, stop, tag, end, attrs))
            if again:
                at = stop
                break
        if not again:
            break
    if not hidden:
        return out
    shown, k = [], 0
    while k < len(out):
        last = hidden.get(k, k)
        shown.append((out[k][0], out[last][1], "", False, "") if last > k else out[k])
        k = last + 1
    return shown


def wrappers(found: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Numbers of the start tags among found that hold a main element, or are forms around parts of a page."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    mains = parts = 0  # how many open elements, from the outermost, are known to hold them
    for k, (_, _, tag, end, _) in enumerate(found):
        if tag not in CONTAINERS:
            continue
        if end:
            if open_[tag]:
                while True:
                    name, _ = stack.pop()
                    open_[name] -= 1
                    if name == tag:
                        break
                mains, parts = min(mains, len(stack)), min(parts, len(stack))
            continue
        if tag == "main":
            out.update(n for _, n in stack[mains:])
            mains = len(stack)
        if tag in PAGE_PARTS:
            out.update(n for t, n in stack[parts:] if t == "form")
            parts = len(stack)
        stack.append((tag, k))
        open_[tag] += 1
    return out


def blocks(page: str) -> list[tuple[str, dict[str, float], tuple[int, int, int]]]:
    """(text, inputs of the classifier, place) of all blocks in page order; the place is the innermost element around a block, the one around that, and how deep it is."""
    out: list = []
    stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]  # tag, id, bad, good, whether an article inside stays bad
    open_: Counter[str] = Counter()
    found = tokens(page)
    around = wrappers(found)
    text: list[str] = []
    linked = links = 0
    leaf, number, at = "", 0, 0

    def flush():
        nonlocal text, linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                _, _, bad, good, _ = stack[-1]
                n = len(words)
                share = min(1.0, linked / n)
                x = {"bad": float(min(bad, 2)), "good": float(min(good, 1)) if not bad else 0.0, "links": share, "length": min(1.5, math.log10(n) - 1), "heading": float(leaf in ("h1", "h2", "h3") and not bad), "sentence": float(words[-1] in ".!?…\"”»"), "list": float(leaf in ("li", "dt", "dd", "option"))}
                out.append((words, x, (stack[-1][1], stack[-2][1] if len(stack) > 1 else -1, len(stack))))
            text = []
        linked = 0

    for k, (start, stop, tag, end, attrs) in enumerate(found):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if links:
                linked += len(piece)
        at = stop
        if not tag:
            continue
        if tag == "a":
            links = 0 if end else 1
        elif tag in BREAKS:
            flush()
            if end:
                leaf = ""
                if open_[tag]:
                    while True:
                        name = stack.pop()[0]
                        open_[name] -= 1
                        if name == tag:
                            break
            else:
                links = 0
                leaf = tag
                if tag in CONTAINERS and tag not in VOID:
                    number += 1
                    _, _, bad, good, firm = stack[-1]
                    names, whole = set(), set()
                    if "=" in attrs:
                        for n in _NAMES.findall(attrs):
                            name = _LAYOUT.sub(" ", "".join(n).lower())
                            names.update(_WORD.findall(name))
                            whole.update(name.split())
                    inside = good and tag == "header"  # an article's own heading
                    wide = tag in ("html", "body") or k in around and tag not in FIRM_TAGS
                    if tag == "main" or tag == "article" and not firm:
                        bad, firm = 0, False
                    against = names & BAD_WORDS
                    if good and not bad:  # in an article only names that say nothing else speak against it
                        said = [set(_WORD.findall(n)) for n in whole]
                        against = set().union(*(w & BAD_WORDS for w in said if w - GENERIC <= BAD_WORDS)) - SOFT_WORDS
                    bad += not wide and (tag in BAD_TAGS or (tag == "header" and not inside) or bool(against) and not (inside or (tag in GOOD_TAGS and not names & {"comment", "comments", "reply"})))
                    good += tag in GOOD_TAGS or (not wide and not bad and bool(names & GOOD_WORDS))
                    firm = firm or not wide and tag not in GOOD_TAGS and (tag in FIRM_TAGS or bool(names & FIRM_WORDS or whole & FIRM_NAMES))
                    stack.append((tag, number, bad, good, firm))
                    open_[tag] += 1
        elif tag == "br":
            text.append(" ")
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def max_flow(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; edges (i, j, capacity) go both ways."""
    # what passes a node straight from source to sink needs no search
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def add(i: int, j: int, c: int, back: int) -> None:
        graph[i].append(len(to))
        to.append(j), cap.append(c)
        graph[j].append(len(to))
        to.append(i), cap.append(back)

    for i, e in enumerate(excess):
        if e > 0:
            add(s, i, e, 0)
        elif e < 0:
            add(i, t, -e, 0)
    for i, j, c in edges:
        add(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for i in queue:
            for e in graph[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        step = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:  # a blocking flow
            if i == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            own = graph[i]
            while step[i] < len(own) and not (cap[own[step[i]]] and level[to[own[step[i]]]] == level[i] + 1):
                step[i] += 1
            if step[i] < len(own):
                path.append(own[step[i]])
                i = to[own[step[i]]]
            elif path:
                i = to[path.pop() ^ 1]
                step[i] += 1
            else:
                break


def label(found: list[tuple[str, dict[str, float], tuple[int, int, int]]]) -> list[bool]:
    """Whether each block is content. A page has some, if any block isn't bad: where none stands out the classifier's bias goes up by PRIOR."""
    if not found:
        return []
    edges = []
    last: dict[int, int] = {}
    for i, (_, _, (inner, outer, depth)) in enumerate(found):
        if i:
            before = found[i - 1][2]
            edges.append((i - 1, i, int(_SCALE * (SIBLING if before[0] == inner else COUSIN if before[1:] == (outer, depth) and depth > 2 else ADJACENT))))
        if last.get(inner, i) < i - 1:  # the same element resumes after another one
            edges.append((last[inner], i, int(_SCALE * SIBLING)))
        last[inner] = i
    for bias in (WEIGHTS["bias"], WEIGHTS["bias"] + PRIOR):
        scores = [bias + sum(WEIGHTS[k] * v for k, v in x.items()) for _, x, _ in found]
        cost = lambda score: int(_SCALE * math.log1p(math.exp(min(30, score))))
        kept = max_flow(len(found), [cost(x) for x in scores], [cost(-x) for x in scores], edges)
        if any(kept):
            break
    return kept


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join([b[0] for b, keep in zip(found, label(found), strict=True) if keep])


def extract(df: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """df with the main text in the column `into` in place of the page."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    keep = [c for c in df.columns if c not in (page, into)]
    schema = StructType([df.schema[c] for c in keep] + [StructField(into, StringType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(page)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema=arrow)

    return df.select(*keep, page).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
