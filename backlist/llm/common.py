"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from backlist.session import shared_dir

# bytes of text handled by one vectorised step inside a task
BLOCK_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        import backlist
        top = os.path.dirname(os.path.abspath(backlist.__file__))
        with tempfile.TemporaryDirectory() as tmp:
            src = shutil.copytree(top, f"{tmp}/src/backlist", ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/backlist-package", "zip", os.path.dirname(src)))
        _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder and read it back:
    cuts the lineage, survives lost executors.  The folder is removed when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of ``column`` each (a
    single longer row is a slice of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = total[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(total, base + max_bytes, side="right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, start, end, doc)`` of all words ``[^ \\t-\\r]+`` of the texts.

    The texts are joined by one space, so no word spans two of them.  ``doc``
    has the first word's index of each text, and the number of words last.
    """
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SEP[buf].view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buf, start, end, np.searchsorted(start, offset + 1)


_P = np.uint64(0x9E3779B97F4A7C15)
_T = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_T = _T * np.uint64(2) + np.uint64(1)
_POW: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _POW or len(_POW[name]) < n:
        p = np.full(max(n, 1024), base, dtype=np.uint64)
        p[0] = 1
        _POW[name] = np.multiply.accumulate(p)
    return _POW[name][:n]


_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prefix(values: np.ndarray) -> np.ndarray:
    s = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_P, len(values), "p"), out=s[1:])
    return s


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one prefix sum over the block."""
    s = _prefix(_T[buf])
    inv = _powers(_P_INV, len(buf) + 1, "inv")
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64) * _P)


def gram_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``words[lo:hi]`` of hashed words."""
    s = _prefix(words)
    inv = _powers(_P_INV, len(words) + 1, "inv")
    return mix((s[hi] - s[lo]) * inv[lo] + (hi - lo).astype(np.uint64) * _P)
