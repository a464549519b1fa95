"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary is a file of a public tokenizer in the ``tokenizers`` JSON format; it is never trained
here. For each pre-token a segment tree holds one leaf per symbol: the rank of the merge of that
symbol with its right neighbour (infinite where there is none). Its root yields the leftmost pair of
lowest rank; a merge changes three leaves, each updated in logarithmic time, until no mergeable pair
remains. Very long pre-tokens thus cost n log n. The trees of short ones, of a single node, are the
columns of one array, and a step merges one pair in each of them. Pre-tokens repeat, so each worker memoises
them, and the stretches between spaces (bounded: a memory is emptied at CACHE entries, which changes no result).

Edge cases: a null or empty text has no ids and decodes to the empty text; the strings of special
tokens in a text become their ids, as in the library's default; any other column is ignored, rows
repeat as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries a worker memoises before it starts anew.
CACHE = 800_000
#: Longer strings aren't memoised.
LONGEST = 64
#: Bytes of texts whose new pre-tokens are merged together; those of longer texts are merged one by one.
PIECE = 4 << 20

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Children of a node of the segment tree, as a power of two: the least of a list slice is found at C speed.
FAN = 4


def merge_all(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges {left << 20 | right: rank << 20 | merged}, lowest rank first and leftmost among equals."""
    n = len(ids)
    get, none = merges.get, 1 << 62
    # a leaf holds rank << 40 | place, so that the least key is the leftmost pair of the lowest rank
    leaves = [none if (m := get(a << 20 | b)) is None else (m >> 20) << 40 | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    tree = [leaves]
    while len(tree[-1]) > 1 << FAN:
        low = tree[-1]
        tree.append([min(low[k : k + (1 << FAN)]) for k in range(0, len(low), 1 << FAN)])
    top, above = tree[-1], tree[1:]
    if not top or min(top) == none:
        return ids
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := min(top)) != none:
        i = root & 0xFFFFFFFFFF
        j = after[i]
        merged = ids[i] = get(ids[i] << 20 | ids[j]) & 0xFFFFF
        ids[j] = -1
        k, h = after[j], before[i]
        after[i] = k
        leaves[i] = none
        if k < n:
            leaves[j] = none
            before[k] = i
            if (m := get(merged << 20 | ids[k])) is not None:
                leaves[i] = (m >> 20) << 40 | i
        if h >= 0:
            m = get(ids[h] << 20 | merged)
            leaves[h] = none if m is None else (m >> 20) << 40 | h
        if above:
            changed, low = {i >> FAN, h >> FAN if h >= 0 else i >> FAN, j >> FAN if k < n else i >> FAN}, leaves
            for level in above:
                for x in changed:
                    level[x] = min(low[x << FAN : x + 1 << FAN])
                changed, low = {x >> FAN for x in changed}, level
    return [x for x in ids if x >= 0]


class Forest:
    """The merges of many short pre-tokens at once: the trees of those of one length are the columns of an array."""

    #: Leaf where there is no merge.
    NONE = np.int64(1 << 62)

    def __init__(self, first: list[int], merges: dict[int, int]) -> None:
        self.pairs = np.array(sorted(merges), np.int64)
        value = np.array([merges[k] for k in self.pairs.tolist()], np.int64)
        self.leaf, self.merged = (value >> 20) << 8, np.zeros(int((value >> 20).max(initial=0)) + 1, np.int32)  # ranks may have gaps
        self.merged[value >> 20] = value & 0xFFFFF
        self.first = np.array(first, np.int32)
        two = self.leaves(np.repeat(self.first, 256), np.tile(self.first, 256)) if len(self.pairs) else np.full(1 << 16, self.NONE)
        self.two = two.reshape(256, 256)

    def leaves(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank << 8 of the merge of each a with b; NONE where there is none or an id is -1."""
        pair = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.leaf[at], self.NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length, of 2 to 255 bytes."""
        w, n = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(w, n).T
        # row n stands for what is before the first and after the last symbol
        ids = np.full((n + 1, w), -1, np.int32)
        ids[:n] = self.first[raw]
        leaves = np.full((n + 1, w), self.NONE)
        leaves[: n - 1] = self.two[raw[:-1], raw[1:]] | np.arange(n - 1)[:, None]
        after = np.repeat(np.append(np.arange(1, n + 1), n), w)
        before = np.repeat(np.append(n, np.arange(n)), w)
        flat, leaf = ids.ravel(), leaves.ravel()
        while True:
            root = leaves.min(0)
            c = np.flatnonzero(root != self.NONE)
            if not len(c):
                break
            root = root[c]
            i = root & 255
            at = i * w + c
            j = after[at] * w + c
            k = after[j]
            h = before[at]
            merged = flat[at] = self.merged[root >> 8]
            flat[j], leaf[j] = -1, self.NONE
            after[at], before[k * w + c] = k, i
            leaf[at] = self.leaves(merged, flat[k * w + c]) | i
            leaf[h * w + c] = self.leaves(flat[h * w + c], merged) | h
            np.minimum(leaf, self.NONE, out=leaf)
        ids = ids.T
        left = ids >= 0
        found, ends = ids[left].tolist(), np.cumsum(left.sum(1)).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Memo(dict):
    """A bounded dictionary that computes what it lacks; it is emptied when full."""

    def __init__(self, work, size: int = CACHE) -> None:
        super().__init__()
        self.work, self.size = work, size

    def __missing__(self, key: str):
        got = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.clear()
            self[key] = got
        return got


class ByteBPE:
    """A byte-level BPE vocabulary with encode() and decode()."""

    def __init__(self, path: str) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.first = [vocab[c] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.comma = {i: b",%d" % i for i in self.token_bytes}
        self.split = regex.compile(PATTERN).findall
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.forest = Forest(self.first, self.merges)
        self.whole = Memo(self.chunk)
        self.spaced = Memo(lambda t: self.chunk(" " + t))
        self.tokens = Memo(lambda t: self.written(merge_all([self.first[b] for b in t.encode("utf-8", "replace")], self.merges)))

    def written(self, ids: list[int]) -> tuple[bytes, bytes]:
        """b',id' for each id, and the bytes they decode to."""
        return b"".join(map(self.comma.__getitem__, ids)), b"".join(map(self.token_bytes.__getitem__, ids))

    def chunk(self, text: str) -> tuple[bytes, bytes]:
        """written() of a stretch that no pre-token crosses."""
        return self.join(self.split(text))

    def join(self, tokens: list[str]) -> tuple[bytes, bytes]:
        got = [self.tokens[t] for t in tokens]
        return got[0] if len(got) == 1 else (b"".join([x for x, _ in got]), b"".join([x for _, x in got]))

    def learn(self, texts: list[str]) -> None:
        """Memoise the stretches of texts that are new, merging their new pre-tokens together."""
        fresh: set[str] = set()
        for text in texts:
            if len(text) <= PIECE:
                fresh.update(text.split(" "))
        fresh = {t for t in fresh - self.spaced.keys() if len(t) <= LONGEST}
        found = {t: self.split(" " + t) for t in fresh}
        new = set().union(*found.values())
        for memo, size in ((self.tokens, len(new)), (self.spaced, len(found))):
            if len(memo) + size > memo.size:
                memo.clear()
        by: dict[int, list[tuple[str, bytes]]] = {}
        for t in new - self.tokens.keys():
            raw = t.encode("utf-8", "replace")
            if 2 <= len(raw) <= (1 << FAN) + 1:  # leaves of one node
                by.setdefault(len(raw), []).append((t, raw))
        for same in by.values():
            for (t, _), ids in zip(same, self.forest.merge([raw for _, raw in same]), strict=True):
                self.tokens[t] = self.written(ids)
        for t, tokens in found.items():
            self.spaced[t] = self.join(tokens)

    #: White space before a space: there a pre-token may cross the place where a chunk would start.
    _run = re.compile(r"\s ")

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        got = []
        for part in self.parts(text) if "<" in text else [text]:
            if part in self.special:
                got.append((b",%d" % self.special[part], part.encode()))
            elif self._run.search(part):
                got.append(self.chunk(part))
            elif part:  # each space starts a pre-token, so the stretches from space to space are independent
                head, *rest = part.split(" ")
                if head:
                    got.append(self.whole[head])
                spaced = self.spaced
                got += [spaced[w] for w in rest]
        return got

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.pieces(text) for x in ids.split(b",")[1:]]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text that they decode to."""
        ids, raw = zip(*(self.pieces(text) or [(b"", b"")]), strict=True)
        ids = b"".join(ids)
        decoded = b"".join(raw).decode("utf-8", "replace").encode("utf-8")
        return ids.count(b","), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded).hexdigest()


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with a column ids array<int>."""
    return _map(df, path, text, "ids array<int>", lambda bpe, t: (bpe.encode(t),), True)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256, decoded_sha256; the ids are decoded again, never kept."""
    return _map(df, path, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda bpe, t: bpe.digest(t), True)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with a column decoded; null ids are an empty list."""
    return _map(df, path, ids, "decoded string", lambda bpe, x: (bpe.decode(x or []),))


def _map(df: DataFrame, path: str, column: str, added: str, work, learns: bool = False) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(added)
    clash = {f.name.lower() for f in more}
    kept = df.select(*[c for c in df.columns if c.lower() not in clash or c == column])
    schema = StructType([f for f in kept.schema if f.name.lower() not in clash] + list(more))

    def run(batches):
        from .common import by_bytes, keeps, room_for

        room_for("bpe")
        keeps("bpe", load.cache_clear)
        bpe, arrow = load(path), to_arrow_schema(schema)
        for batch in batches:
            if learns:
                done = []
                for _, part in by_bytes(batch.column(column).cast(pa.large_string()), PIECE):
                    some = [x or "" for x in part.to_pylist()]
                    bpe.learn(some)
                    done += [work(bpe, x) for x in some]
            else:
                done = [work(bpe, x.as_py() if x.is_valid else "") for x in batch.column(column)]
            new = [pa.array([d[k] for d in done], arrow.field(f.name).type) for k, f in enumerate(more)]
            old = [batch.column(f.name) for f in schema.fields[: len(schema) - len(more)]]
            yield pa.RecordBatch.from_arrays(old + new, schema=arrow)

    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digests(docs, vocabulary("byte_bpe_50k.json")).drop("text")
