"""Quality classifier: a generalised additive model with pairwise interactions.

Inputs are FEATURES, computed from the whole text alone. Training: each feature is cut into quantile
bins; rounds of cyclic boosting visit the features in turn, fit a shallow tree (up to four leaves) to
the gradients by bin and add it to that feature's lookup table; then the pairs whose trees would explain
most of what is left get two-dimensional tables the same way. A score is the logistic function of the
intercept and the tables' values: vectorised bin look-ups and additions.

The model is fitted on the driver to at most SAMPLE labelled rows, those of least hash, none held out.
Every text is scored in full.

Edge cases: a null or empty text gets the features of the empty text and a score; labels that are null,
or of null ids, teach nothing, and of several labels of an id the smallest counts; without labels of both
kinds the score is their mean, or 0.5; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, release, room_for, table, utf8_column
from .jaccard_join import PIECE, words

#: Labelled rows the model is fitted to, at most.
SAMPLE = 12_000
#: Parts by crc32 of the id, of which part 0 is held out.
FOLDS = 5
#: Score from which on a text is predicted to be good.
THRESHOLD = 0.3
BINS, ROUNDS, RATE, LEAST = 48, 150, 0.12, 15
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 60

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "upper", "digit", "symbol", "high", "double_symbol",
    "pipe", "exclaim", "stop", "comma", "line_bytes", "repeated_lines", "symbol_ends", "short_words", "long_words", "packed",
)

_CLASS = np.zeros((256, 10), bool)
_CLASS[ord("A") : ord("Z") + 1, 0] = True
_CLASS[ord("0") : ord("9") + 1, 1] = True
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()], 2] = True
_CLASS[128:, 3] = True
for _k, _c in enumerate("|!.,\n"):
    _CLASS[ord(_c), 4 + _k] = True
_CLASS[[0x20, *range(9, 14)], 9] = True
#: A text's bytes that compression looks at in each of its parts, all parts in turn.
_PART = 1 << 16


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of UTF-8 texts laid end to end."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    each = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off]).astype(np.float64)
    upper, digit, symbol, high, pipe, exclaim, stop, comma, line, space = (each(_CLASS[:, k][data]) for k in range(10))
    mark = _CLASS[:, 2][data]
    first = np.zeros(len(data) + 1, bool)  # of a text, or the end of all
    first[off] = True
    twice = np.zeros(len(data), bool)
    twice[1:] = mark[1:] & (data[1:] == data[:-1]) & ~first[1:-1]
    # a symbol before white space or the end, other than full stops and commas
    blank = np.append(_CLASS[:, 9][data], True)
    ends = mark & (data != ord(".")) & (data != ord(",")) & (blank[1:] | first[1:])
    text, h = words(data, off)
    at = np.searchsorted(text, np.arange(n + 1))
    solid = ~blank[:-1]
    begin = np.flatnonzero(solid & (np.concatenate([[True], blank[:-2]]) | first[:-1])[: len(solid)])
    length = np.flatnonzero(solid & (blank[1:] | first[1:])) + 1 - begin
    home = np.searchsorted(off, begin, "right") - 1
    short, long = (np.bincount(home[x], minlength=n).astype(np.float64)[:n] for x in (length <= 2, length >= 14))
    count = np.diff(at).astype(np.float64)
    out = np.zeros((n, len(FEATURES)))
    some, w, letters = np.maximum(size, 1), np.maximum(count, 1), np.maximum(size - space - symbol - digit, 1)
    distinct, top, repeated, packed = (np.zeros(n) for _ in range(4))
    raw = data.tobytes()
    for i in range(n):
        if at[i + 1] > at[i]:
            x = np.sort(h[at[i] : at[i + 1]])
            cut = np.flatnonzero(x[1:] != x[:-1])
            distinct[i] = (len(cut) + 1) / len(x)
            top[i] = np.diff(np.concatenate([[-1], cut, [len(x) - 1]])).max() / len(x)
            part = raw[off[i] : off[i + 1]]
            lines = part.split(b"\n")
            if len(lines) > 1:
                repeated[i] = 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines)))
            packed[i] = sum(len(zlib.compress(part[k : k + _PART], 1)) for k in range(0, len(part), _PART)) / len(part)
    columns = [
        np.log1p(size), np.log1p(count), (size - space) / w, distinct, top, upper / letters, digit / some, symbol / some, high / some, each(twice) / w,
        pipe / w, exclaim / w, stop / w, comma / w, size / (line + 1), repeated, each(ends) / w, short / w, long / w, packed,
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def _column_features(column):
    parts = [features(*utf8_column(part)) for _, part in by_bytes(column, PIECE)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class Model:
    """Intercept, cuts and tables; small, so it travels with the tasks."""

    def __init__(self, intercept: float = 0.0) -> None:
        self.intercept = intercept
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        b = self.bins(x)
        for k, t in enumerate(self.tables):
            total += t[b[k]]
        for i, j, t in self.pairs:
            total += t[coarse(b[i], self.cuts[i]), coarse(b[j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def coarse(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(cuts) + 1)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, int]:
    """(gain, place) of the best split of a run of bins."""
    G, H, N = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    fits = (N >= least) & (n.sum() - N >= least)
    if not fits.any():
        return 0.0, 0
    a, b = g.sum(), h.sum()
    gain = np.where(fits, G**2 / (H + 1) + (a - G) ** 2 / (b - H + 1) - a**2 / (b + 1), -1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Values by bin of a tree of up to four leaves, split where the gain is greatest."""
    out = np.zeros(len(g))
    leaves = [(0, len(g))]
    for _ in range(3):
        best = max(((*_cut(g[a:b], h[a:b], n[a:b], least), a, b) for a, b in leaves if b - a > 1), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        leaves.remove((a, b))
        leaves += [(a, a + k), (a + k, b)]
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree over two features that splits the first and then each side on the second."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + 1)
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        for k in range(1, len(a)):
            value, parts = -base, []
            for rows in (slice(0, k), slice(k, None)):
                x, y, z = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                gain, at = _cut(x, y, z, least)
                for cols in (slice(0, at), slice(at, None)) if gain > 0 else (slice(0, None),):
                    s, t = x[cols].sum(), y[cols].sum()
                    value += s**2 / (t + 1)
                    parts.append((rows, cols, s / (t + 1)))
            if value > best:
                best, out = value, np.zeros_like(g)
                view = out.T if flip else out
                for rows, cols, v in parts:
                    view[rows, cols] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Model(float(np.log(p / (1 - p))))
    p = y.mean()
    least = min(LEAST, max(3, len(y) // 60))  # rows of a leaf
    model = Model(float(np.log(p / (1 - p))))
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b = model.bins(x)
    count = [np.bincount(b[k], minlength=len(t)) for k, t in enumerate(model.tables)]
    total = np.full(len(y), model.intercept)
    prob = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            q = prob()
            step = RATE * tree(np.bincount(b[k], y - q, len(t)), np.bincount(b[k], q * (1 - q), len(t)), count[k], least)
            t += step
            total += step[b[k]]
    c = [coarse(b[k], model.cuts[k]) for k in range(x.shape[1])]
    grid = lambda i, j, v: np.bincount(c[i] * PAIR_BINS + c[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    q = prob()
    gains = sorted(((tree2(grid(i, j, y - q), grid(i, j, q * (1 - q)), grid(i, j, None), least)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            q = prob()
            step = RATE * tree2(grid(i, j, y - q), grid(i, j, q * (1 - q)), grid(i, j, None), least)[1]
            t += step
            total += step[c[i], c[j]]
    return model


def fold(key):
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit to labelled documents of which the id is not in the held-out part."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__y"))
    one = one.where(fold(F.col(key)) != 0).orderBy(F.xxhash64(key), key).limit(sample).select(F.col(key).alias("__k"), "__y")
    # at most `sample` ids: a broadcast of bounded size
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(one), "__k")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _column_features(batch.column("__t"))
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__k").cast(pa.int64()), batch.column("__y").cast(pa.int64()), raw], names=["k", "y", "raw"])

    # one row for each id, however often an id comes: at most `sample` rows reach the driver
    made = rows.select("__k", "__y", "__t").mapInArrow(run, "k long, y long, raw binary")
    got = made.groupBy("k").agg(F.min("y").alias("y"), F.min("raw").alias("raw")).toArrow()
    x = np.frombuffer(b"".join(got.column("raw").to_pylist()), np.float64).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, got.column("k").to_numpy()))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kept = [f for f in docs.schema if f.name.lower() not in ("score", "predicted")]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    names = [f.name for f in kept]

    def run(batches):
        arrow = to_arrow_schema(schema)
        room_for("sets")  # the same words are cut
        for batch in batches:
            s = model.score(_column_features(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], schema=arrow)
        release()

    return docs.select(*names).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
