"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Where that is unset a session on one machine (master local) gets a temporary folder, kept for its life; on a
    cluster it is an error, as executors would write where nobody else reads.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("tessera.shared.dir", None)
        if not at:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("tessera.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables that stage() made, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of the whole column: sizes what follows."""
    return int(df.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), element by element."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array (nulls are empty) and the n + 1 offsets of its values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset :]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if len(a) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def by_bytes(column, most: int):
    """(first row, slice) of an Arrow string array, each of about `most` bytes, or one longer value."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    end = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
        yield at, a.slice(at, stop - at)
        at = stop


def pack(arrays: dict, compress: bool = False) -> bytes:
    """Arrays as bytes; compressed where they hold text."""
    import pickle

    raw = pickle.dumps(arrays, protocol=5)
    if compress:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(raw)
    return raw


def unpack(raw: bytes, compressed: bool = False) -> dict:
    import pickle

    if compressed:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw)
    return pickle.loads(raw)


def split_by(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, indexes) of each value of part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    cut = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return [(int(part[x[0]]), x) for x in np.split(order, cut)]


_kept: dict[str, object] = {}


def keeps(owner: str, forget) -> None:
    """Say that this worker keeps memory for the tasks of an operator that come after; forget() drops it."""
    _kept[owner] = forget


def room_for(owner: str) -> None:
    """Called as a task begins: what other operators kept in this worker is dropped, as workers outlive their tasks."""
    others = [o for o in _kept if o != owner]
    for o in others:
        _kept.pop(o)()
    if others:
        release()


def release() -> None:
    """Give freed memory back to the system; workers live on after a task with large arrays."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has collected the plans that made them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
