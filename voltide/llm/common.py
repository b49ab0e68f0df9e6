"""Helpers the operators share: tables, text buffers, scratch tables."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltide.session import shared_folder

# bytes of text that a task turns into arrays at a time
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def packed(docs: DataFrame, *but: str):
    """All columns of ``docs`` except some as one struct ``row``, so that no name can clash with a helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (first, last) that hold at most ``limit`` bytes, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


# --- fixed values: an odd base of the polynomial hash and its inverse modulo 2**64 ------------
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums of code * BASE ** place over all prefixes, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the codes in every [start, end), the same wherever they stand."""
    scale = powers(INVERSE, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * scale[starts] + (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit code for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[data]
