"""Quality rules with cross-document line frequency.

Lines of a document are normalised (lower case, one space between words) and hashed. Of each
host, the distinct documents that hold a line are counted; a line found in more than ``max_documents`` of them, and in
more than ``max_percent`` of all that the host has, is boilerplate there and is removed: what is common
is judged by the host's size, and a small host's few lines are not. A document left with too small a
share of its words is depleted and rejected; one that loses a line or two is not. ``cleaned_documents`` gives the
documents that are kept, without those lines.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; repeated rows and repeated ids are documents and give one result row each; an empty table gives no rows;
columns other than those named are ignored, and pass through ``cleaned_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, combine, shared_table, span_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_FIELDS = [
    ("n_words", "bigint"),
    ("word_chars", "bigint"),
    ("n_symbols", "bigint"),
    ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"),
    ("lines", "array<bigint>"),
    ("line_words", "array<int>"),
]


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Of each text, the words that lie in a 3-word window which the text holds twice or more."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        inside = words.doc[2:] == words.doc[:-2]
        at = np.flatnonzero(inside)
        keys = combine(hashes[at], hashes[at + 1], hashes[at + 2], words.doc[at].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return np.bincount(words.doc[covered], minlength=words.n)


def measure(texts: list[bytes]) -> dict[str, pa.Array]:
    """Base statistics and normalised lines of each text."""
    words = Words(texts)
    data = words.data
    space_or_tail = ((data & 0xC0) == 0x80) | np.isin(data, [32, 9, 10, 11, 12, 13])
    # lines: every text ends with a line feed of its own
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    line_first, line_last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = line_last > line_first
    starts, ends, line_first, line_last = starts[full], ends[full], line_first[full], line_last[full]
    line_doc = words.doc[line_first] if len(line_first) else np.zeros(0, np.int64)
    raw = combine(span_hashes(data, starts, ends), line_doc.astype(np.uint64))
    n_lines = np.bincount(line_doc, minlength=words.n)
    unique = np.unique(raw, return_index=True)[1]
    n_dup = n_lines - np.bincount(line_doc[unique], minlength=words.n)

    lowered = np.frombuffer(data.tobytes().lower(), np.uint8)
    normal = span_hashes(span_hashes(lowered, words.starts, words.ends), line_first, line_last)
    offsets = pa.array(np.concatenate(([0], np.cumsum(n_lines))).astype(np.int32))
    return {
        "n_words": pa.array(words.count.astype(np.int64)),
        "word_chars": pa.array(words.per_text(~space_or_tail)),
        "n_symbols": pa.array(words.per_text(_SYMBOL[data])),
        "n_dup_lines": pa.array(n_dup.astype(np.int64)),
        "n_repeat_words": pa.array(_repeated_words(words, words.hashes()).astype(np.int64)),
        "lines": pa.ListArray.from_arrays(offsets, pa.array(normal.view(np.int64))),
        "line_words": pa.ListArray.from_arrays(offsets, pa.array((line_last - line_first).astype(np.int32))),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], *found.values()], names=["doc_id", "host", "text_key", *found])


def _key(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def _judged(docs: DataFrame, host: str, max_documents: int, max_percent: int, min_left_percent: int) -> DataFrame:
    """One row per document, with the places of its removed lines among its lines with words.

    One pass over the texts writes the narrow table of statistics and line hashes; all that
    follows works on that. Counts are combined before their shuffle, so a line that a third
    of a host's documents share costs each task one row.
    """
    text = F.col("text").cast("string")
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), _key(text).alias("text_key"), text.alias("text"))
    schema = "doc_id bigint, host string, text_key bigint, " + ", ".join(f"{n} {t}" for n, t in _FIELDS)
    # a row number once written: rows with equal ids stay apart
    base = shared_table(columns.mapInArrow(_measured, schema).withColumn("row", F.monotonically_increasing_id()), "line-rules")
    sizes = base.groupBy("host").agg(F.count("*").alias("documents")).select(F.col("host").alias("of"), "documents")
    frequent = (
        base.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("found"))
        .filter(F.col("found") > max_documents)
        .join(sizes, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("found") * 100 > F.col("documents") * max_percent)
        .select("of", F.col("line").alias("common"))
    )
    each = base.select("row", "host", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "x")).select("row", "host", "place", "x.lines", "x.line_words")
    removed = (
        each.join(frequent, (F.col("lines") == F.col("common")) & F.col("host").eqNullSafe(F.col("of")))
        .groupBy("row")
        .agg(F.sum("line_words").alias("removed_words"), F.count("*").alias("removed_lines"), F.collect_list("place").alias("removed"))
    )
    n, left = F.col("n_words"), F.col("n_words") - F.col("removed_words")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    return (
        base.drop("lines", "line_words")
        .join(removed, "row", "left")
        .fillna(0, ["removed_words", "removed_lines"])
        .withColumn("base_failed", failed)
        .withColumn("depleted", left * 100 < n * min_left_percent)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def line_frequency_rules(docs: DataFrame, host: str = "source", max_documents: int = 20, max_percent: int = 1, min_left_percent: int = 30) -> DataFrame:
    """One row per document: base statistics, removed and left words, the verdict."""
    return _judged(docs, host, max_documents, max_percent, min_left_percent).drop("row", "text_key", "removed")


def cleaned_documents(docs: DataFrame, host: str = "source", max_documents: int = 20, max_percent: int = 1, min_left_percent: int = 30) -> DataFrame:
    """The kept rows of ``docs``, all columns, with the text that is left; texts that lose no line stay as they are, others lose empty lines, too."""
    judged = _judged(docs, host, max_documents, max_percent, min_left_percent).filter("kept")
    # rows that are equal in id, host and text have one verdict
    verdict = judged.groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_key").alias("_key")).agg(F.first("removed").alias("_removed"))
    text = docs["text"].cast("string")
    met = docs.join(verdict, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & docs[host].cast("string").eqNullSafe(F.col("_host")) & (_key(text) == F.col("_key")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(F.col("_removed"), k)), "\n")
    cleaned = F.when(F.col("_removed").isNull(), text).otherwise(left)
    return met.select(*((cleaned.alias("text") if c == "text" else docs[c]) for c in docs.columns))
