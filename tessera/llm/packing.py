"""Packing tokenised documents into sequences of fixed length by cutting-stock column generation.

A document's ids end with the end id. It is cut into full pieces of `length` ids, one piece of a
multiple of `grain` ids and a tail of under `grain` ids, so that only length/grain + grain classes of
piece length exist. Their histogram (bounded by the parameters, whatever the input) goes to the driver,
where a linear program chooses how often to use each pattern of classes: columns are priced by a
knapsack dynamic program on the dual prices until none improves. The programme's rates are rounded
down, what is left is packed first-fit decreasing on the histogram, and the slots of all patterns are
dealt to the pieces by their rank within their class. Ranks are counted in salted parts of each class,
so a class with a third of all rows is no single task.

Each sequence is padded to `length` by its reader; only sequences of the last patterns are not full.

Edge cases: a null or empty text has the end id alone; rows repeat as often as they come; a null key
is carried along; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import warnings
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, vocabulary
from .common import keeps, release, room_for, stage, table

#: Salted parts in which the pieces of a class are ranked, at least, and pieces for each.
PARTS, PART = 64, 1_000_000
#: Words that a worker memoises before it starts anew.
WORDS = 500_000
#: Characters of the texts that are encoded together.
TOGETHER = 1 << 21
#: Columns that the linear program generates at most; it ends earlier when no pattern improves it, and warns otherwise.
COLUMNS = 5000


class Words(dict):
    """Numbers of words; a word that is new gets the next one and waits in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class WordBPE:
    """A lower-casing tokenizer file; words repeat, so each worker encodes a word once, until it starts anew.

    New words are normalised and cut into pre-tokens here, as the file says, and the library's model encodes many of
    them as one text. Each pre-token ends with a token that says so, which tells the ids of the words apart.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(bare))
        #: The characters that stand for bytes; the space stays, as it parts the pre-tokens.
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet()) if b != ord(" ")}
        self.pre_tokens = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.words, self.ids = Words(), []
        #: What the whole library must see: special tokens, a final sigma, white space on which splitters differ, marks that NFC joins across.
        self.odd = regex.compile(r"<\||[\x1c-\x1f\x85Σİ᠎\p{M}ᄀ-ᇿ]").search
        self.odd_latin = re.compile(r"<\||[\x1c-\x1f\x85]").search
        #: Marks that end a word are a pre-token of their own, so words are the same with and without them.
        self.part = functools.partial(re.compile(r"(?<=[a-z])([.,!?;:|*$%&#]+)(?!\S)").sub, r" \1")

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, in lower case."""
        pieces = [w if w.isalpha() else " ".join(self.pre_tokens(w)) for w in words]
        text = " ".join(pieces)
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):  # rare: what a word consists of may change
                return [self._ids(w) for w in words]
            text = text.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
        ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        raw, at = ids.tobytes(), stop[np.cumsum([p.count(" ") + 1 for p in pieces]) - 1].tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _words(self, text: str) -> list[int] | None:
        """Numbers of a text's words; None if the library must see the whole."""
        try:
            text.encode("latin-1")
            odd = self.odd_latin(text)
        except UnicodeEncodeError:
            odd = self.odd(text)
        return None if odd else list(map(self.words.__getitem__, self.part(text.lower()).split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > WORDS:
            self.words, self.ids = Words(), []
        numbers = [self._words(t) for t in texts]
        fresh, self.words.fresh = self.words.fresh, []
        for at in range(0, len(fresh), 4096):
            self.ids += self._encode(fresh[at : at + 4096])
        look = self.ids.__getitem__
        return [self._ids(t) if n is None else b"".join(map(look, n)) for t, n in zip(texts, numbers, strict=True)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def cuts(n: int, length: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    start = n - n % length
    for size in (n % length // grain * grain, n % length % grain):
        if size:
            out.append((start, size))
            start += size
    return out


def encoded(column, bpe: WordBPE):
    """The ids of each text of an Arrow column, a stretch of texts at a time."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > TOGETHER:
            yield from bpe.encode(held)
            held, size = [], 0
    yield from bpe.encode(held)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, length: int = 2048, grain: int = 16, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens and, if wanted, ids (little-endian 32-bit)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = df.select(F.col(key), F.col(text).alias("__text"))
    schema = StructType([kept.schema[0], *StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)])

    def run(batches):
        room_for("packing")
        keeps("packing", load.cache_clear)
        bpe, arrow = load(path), to_arrow_schema(schema)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, start, size, crc, total, ids = [], [], [], [], [], []
            for i, raw in enumerate(encoded(batch.column("__text"), bpe)):
                raw += end
                for s, n in cuts(len(raw) // 4, length, grain):
                    piece = raw[4 * s : 4 * (s + n)]
                    rows.append(i), start.append(s), size.append(n), crc.append(zlib.crc32(piece)), total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(piece)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, schema=arrow)
        release()

    return kept.mapInArrow(run, schema)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of greatest price that fits."""
    value, choice = np.zeros(length + 1), np.full(length + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    for w in range(1, length + 1):
        n = np.searchsorted(s, w, "right")
        value[w] = value[w - 1]
        if n:
            got = value[w - s[:n]] + p[:n]
            k = int(got.argmax())
            if got[k] > value[w] + 1e-12:
                value[w], choice[w] = got[k], order[k]
    pattern, w = np.zeros(len(sizes), np.int64), length
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(value[length]), pattern


def solve(sizes: np.ndarray, d: np.ndarray, length: int, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns of a basis as columns, prices) of the linear program, by column generation.

    No pattern is worth more than 1 at the prices when it ends, so the demand's worth is a lower bound of the number of
    sequences. Should `columns` patterns not suffice, the prices are scaled down to that and a warning tells the gap.
    """
    basis = np.diag(length // sizes).astype(np.float64)
    for _ in range(columns):
        prices = np.maximum(np.linalg.solve(basis.T, np.ones(len(sizes))), 0)
        value, pattern = best_pattern(sizes, prices, length)
        if value <= 1 + 1e-7:
            return basis, prices / max(value, 1.0)
        use, step = np.linalg.solve(basis, d), np.linalg.solve(basis, pattern.astype(np.float64))
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    warnings.warn(f"column generation stopped after {columns} patterns, within {value - 1:.2%} of the least number of sequences", stacklevel=2)
    return basis, prices / value


def plan(demand: dict[int, int], length: int, columns: int = COLUMNS) -> list[tuple[int, dict[int, int]]]:
    """[(times, {piece length: pieces})]: patterns that use each piece of the histogram exactly once."""
    out = [(n, {s: 1}) for s, n in demand.items() if s == length and n]
    sizes = np.array(sorted((s for s, n in demand.items() if s < length and n), reverse=True), np.int64)
    if not len(sizes):
        return out
    d = np.array([demand[s] for s in sizes], np.float64)
    basis, _ = solve(sizes, d, length, columns)
    use = np.maximum(np.linalg.solve(basis, d), 0)
    times, patterns = np.floor(use + 1e-9).astype(np.int64), np.rint(basis).astype(np.int64)
    left = d.astype(np.int64) - patterns @ times
    while (left < 0).any():  # rounding of the solver
        times[int((patterns[left < 0].sum(0) * (times > 0)).argmax())] -= 1
        left = d.astype(np.int64) - patterns @ times
    chosen = [(int(n), p) for n, p in zip(times, patterns.T, strict=True) if n]
    while left.any():  # first-fit decreasing on what is left
        room, p = length, np.zeros_like(left)
        for k, s in enumerate(sizes):
            p[k] = min(left[k], room // s)
            room -= p[k] * s
        n = int((left[p > 0] // p[p > 0]).min())
        chosen.append((n, p))
        left = left - n * p
    return out + [(n, {int(s): int(c) for s, c in zip(sizes, p, strict=True) if c}) for n, p in chosen]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per piece length: first rank, first sequence, pieces a sequence and offset of each pattern that has it."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first, used = 0, {}
    for times, pattern in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            found.setdefault(size, []).append((used.get(size, 0), first, pattern[size], offset))
            used[size] = used.get(size, 0) + times * pattern[size]
            offset += size * pattern[size]
        first += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in found.items()}


def assign(cut: DataFrame, key: str = "doc_id", max_length: int = 2048, parts: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces(). cut is read twice: stage it first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parts = parts or max(PARTS, cut.count() // PART)
    salted = cut.withColumn("__part", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(parts)))
    counts = salted.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most length / grain + grain rows
    at = slots(plan(histogram, max_length))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    # the join deals pieces as the ranking after it does, so both take one shuffle
    ranked = salted.join(before.select("length", "__part", F.coalesce("__before", F.lit(0)).alias("__before")), ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy("length", "__part").orderBy(key, "start", "ids_crc32")) - 1)
    names = cut.columns
    schema = StructType([*cut.schema, *StructType.fromDDL("sequence_id long, offset long")])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here = size == s
                ranks, first, each, off = at[int(s)]
                k = np.searchsorted(ranks, rank[here], "right") - 1
                n = rank[here] - ranks[k]
                sequence[here], offset[here] = first[k] + n // each[k], off[k] + n % each[k] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.select(*cut.columns, "__rank").mapInArrow(run, schema)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, length: int = 2048, grain: int = 16, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset; with_ids keeps the ids, so that a sequence can be written out."""
    return assign(stage(pieces(df, path, key, text, end_id, length, grain, with_ids), "pieces"), key, length)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
