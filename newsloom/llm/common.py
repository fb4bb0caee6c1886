"""Shared pieces of the training-data operators.

``shared_table`` cuts lineage through the cluster's shared folder, ``chunks`` walks an
Arrow text column in bounded slices, and ``Words`` finds and hashes the words of a slice
with a handful of vector operations over its bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout. All hashes are 64 bits: a polynomial over the
bytes modulo 2**64 (from one prefix sum, so that any slice costs O(1)), then a finaliser.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
"""Text bytes handled at once; a longer document makes a slice of its own."""

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one made for a local run."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            found = got.get()
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="newsloom-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: what follows survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    cleanup = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # once written, its shuffle files have no readers
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if cleanup is None else spark.conf.set(_CLEANUP, cleanup)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (weakref.ref(table), path)
    return table


_paths: dict[int, tuple[weakref.ref, str]] = {}


def forget(*tables: DataFrame | None) -> None:
    """Delete shared tables that nothing reads any more; others are left alone."""
    for table in tables:
        known = _paths.pop(id(table), None)
        if known is None or known[0]() is not table:
            continue
        delete_path(table.sparkSession, known[1])


def delete_path(spark: SparkSession, name: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: logical nodes over which a scan gives the same rows in the same partitions each time
_STEADY = {"Project", "Filter", "Union", "LogicalRDD", "LocalRelation"}


def same_each_scan(df: DataFrame) -> bool:
    """Whether every scan of ``df`` gives the same partitions: files or given rows, projected and filtered, and nothing else."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        if node.nodeName() not in _STEADY and not (children.size() == 0 and "Relation" in node.nodeName()):
            return False
        todo.extend(children.apply(k) for k in range(children.size()))
    return True


def plain_names(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns that no operator's names meet (``text`` keeps its own), and the columns that name them back."""
    names = ["text" if c == "text" else f"_{k}_given" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def remainder(column: str, divisor: int):
    """crc32 of a column as text, modulo ``divisor``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (64 << 10))
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each values[start:end], with its length mixed in."""
    n = len(values)
    power, inverse = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash for a sequence of hashes, of the same shape each."""
    out = np.full(len(parts[0]), np.uint64(len(parts)) * np.uint64(0xA24BAED4963EE407 >> 8), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out


class Words:
    """Words of some texts, found together.

    ``data``: the bytes, each text ended by a line feed; ``bounds``: where each text starts,
    and the end; ``starts``, ``ends``, ``doc``: of each word, the byte span and the text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.n = len(texts)
        self.bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1, out=self.bounds[1:])
        edge = np.diff(_SPACE[self.data].view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.bounds, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of flagged bytes in each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts come to about ``size`` bytes, with those texts."""
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    begin = total = 0
    for k, text in enumerate(texts):
        if k > begin and total + len(text) > size:
            yield batch.slice(begin, k - begin), texts[begin:k]
            begin, total = k, 0
        total += len(text)
    if texts:
        yield batch.slice(begin), texts[begin:]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, only=None) -> DataFrame:
    """(doc_id, text, label 0/1) of a bounded, reproducible sample of labelled documents.

    ``only``: a condition on doc_id for the labels that may be learned from. The sample is the
    first ``sample`` labelled ids by their hash, so the side that is broadcast has at most that
    many rows; null labels are left out, and of repeated labels the mean decides, a tie for 1. Of documents that
    repeat an id the smallest text by its hash is taken, so the rows are bounded, too.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("_label")).dropna()
    if only is not None:
        marks = marks.filter(only)
    picked = (
        marks.groupBy("doc_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # picked ids are few: their rows are brought together by id, and hardly any has a second
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select("doc_id", "text", F.col("_label").alias(label))
