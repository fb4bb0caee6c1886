"""LM scoring: a word n-gram model by deleted interpolation, of order 3 (or 2).

P(w | u v) = a3(b) c(u v w) / c(u v) + a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket of
the context's frequency (by powers of two; of u v where that was counted, else of v) and each bucket's weights are
learned by expectation-maximisation: of the learned documents a part, chosen by a hash of the id, is held out of the
counts, and the weights that make those held-out counts likeliest under the rest are found. The
model then uses the counts of all learned documents. What stands before a text counts as ends of texts.

Counting. Texts are taken in slices; a slice finds its distinct n-grams with their counts,
as sorted arrays of 64-bit hashes, and deals them by hash range to buckets as packed arrays (differences of sorted
hashes, by byte planes, compressed): one shuffle row for many keys, combined before it leaves the task. A bucket adds up
what it gets and answers each slice with the totals in the order that the slice asked. Slices meet their answers by
slice number, texts travelling compressed. No table of words is ever broadcast or collected, and
a word that is every third token costs each slice one entry.

The slices of a scan must be the same each time; anything but files or rows that are projected and filtered is written out first, and
a slice that gets answers for other keys than it asks for raises an error.

Defined results: a null text is an empty one, whose only token is its end; documents without an id
count as id ''; without learned documents every probability is 1; repeated rows are counted and scored
each; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, combine, forget, remainder, same_each_scan, shared_table

SLICE_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
"""Text bytes whose keys go to a bucket, about."""
HELD_OUT, COUNTED, TUNING = 0, 1, 2
END = np.uint64(0x7F4A7C159E3779B9)
ORDER = 3
LAMBDA_BUCKETS = 32
"""Of the frequency of one context; those of an order's contexts follow on those of the order below."""


def first_weights(order: int) -> np.ndarray:
    """Weights of each bucket before learning, highest order first, the uniform share last; none for estimates without a context."""
    w = np.tile(0.5 ** np.arange(1, order + 2), ((order - 1) * LAMBDA_BUCKETS, 1))
    for k in range(1, order):
        # buckets below those of an order's contexts
        w[: (k - 1) * LAMBDA_BUCKETS + (k == 1), order - 1 - k] = 0
    return w / w.sum(1, keepdims=True)


class Slice:
    """Tokens of some texts: for each order their distinct n-grams, sorted, with counts and places."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        hashes, count = _word_hashes(texts)
        size, n_texts = len(hashes) + len(texts), np.arange(len(texts))
        self.doc = np.repeat(n_texts, count + 1)
        token = np.full(size, END, np.uint64)
        token[np.arange(len(hashes)) + np.repeat(n_texts, count)] = hashes
        begins = np.concatenate(([0], np.cumsum(count + 1)[:-1])) if texts else np.zeros(0, np.int64)
        #: of each order: distinct keys, the place of each token's among them, counts, and of each key its context's place one order below
        self.keys, self.at, self.n, self.context = [], [], [], []
        grams: list[np.ndarray] = [token]
        for k in range(order):
            if k:
                earlier = np.full(size, END, np.uint64)
                earlier[k:] = token[:-k]
                # before a text there are ends only: the token before its first word is the end of another text
                for j in range(1, k):
                    earlier[begins + (k - 1 - j)] = END
                grams = [earlier, *grams]
            joined = token if k == 0 else combine(*grams)
            keys, first, at, n = np.unique(joined, return_index=True, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.at.append(at)
            self.n.append(n)
            if k == 1:
                end = np.searchsorted(self.keys[0], END)
                context = np.concatenate(([end], self.at[0][:-1]))[first] if size else first
                self.context.append(context)
            elif k == 2:
                # a text's first word has no context of two words: the number of texts stands for its count
                context = np.concatenate(([-1], self.at[1][:-1]))
                context[begins] = -1
                self.context.append(context[first])
        self.end = int(np.searchsorted(self.keys[0], END))

    def dealt(self, buckets: int) -> Iterator[tuple]:
        """(bucket, packed keys and packed counts of each order)."""
        cuts = [_cuts(x, buckets) for x in self.keys]
        for b in range(buckets):
            spans = [slice(c[b], c[b + 1]) for c in cuts]
            if any(x.start < x.stop for x in spans):
                yield b, *(v for x, keys, n in zip(spans, self.keys, self.n, strict=True) for v in (packed_keys(keys[x]), packed_counts(n[x])))

    def estimates(self, counts: list[np.ndarray], tokens: int, types: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each distinct n-gram of the highest order: the bucket of its context, and its estimates, highest order first."""
        order = len(self.keys)
        # the places of each highest n-gram's lower ones: those of any token that ends it
        last = np.zeros(len(self.keys[-1]), np.int64)
        last[self.at[-1]] = np.arange(len(self.at[-1]))
        parts = [np.full(len(last), 1.0 / (types + 1)), counts[0][self.at[0][last]] / max(tokens, 1)]
        bucket = np.zeros(len(last), np.int64)
        for k in range(1, order):
            place = self.at[k][last]
            context = self.context[k - 1][place]
            seen = np.where(context >= 0, counts[k - 1][context], counts[0][self.end] if len(counts[0]) else 0)
            parts.append(np.where(seen > 0, counts[k][place] / np.maximum(seen, 1), 0.0))
            bucket = np.where(seen > 0, (k - 1) * LAMBDA_BUCKETS + frequency_bucket(seen), bucket)
        return bucket, parts[::-1]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's number of words; about a megabyte of text is held in the works at once."""
    hashes, counts, begin, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or k + 1 == len(texts):
            w = Words(texts[begin : k + 1], lower=True)
            hashes.append(w.hashes())
            counts.append(w.count)
            begin, size = k + 1, 0
    return np.concatenate(hashes), np.concatenate(counts)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, by byte planes, compressed."""
    if not len(keys):
        return b""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(pa.decompress(packed[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(n: np.ndarray) -> bytes:
    """Counts: a byte each, large ones beside them."""
    if not len(n):
        return b""
    large = n[n >= 255].astype(np.int64)
    small = pa.compress(np.minimum(n, 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
    return len(n).to_bytes(4, "little") + len(large).to_bytes(4, "little") + large.tobytes() + small


def unpacked_counts(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    n, m = int.from_bytes(packed[:4], "little"), int.from_bytes(packed[4:8], "little")
    out = np.frombuffer(pa.decompress(packed[8 + 8 * m :], n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, np.int64, m, 8)
    return out


def _cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[bytes]]]:
    """(number, role, ids, texts) of this task's slices of (doc_id, role, text) rows, each of one role."""
    task = TaskContext.get().partitionId()
    held: dict[int, tuple[list, list]] = {}
    size, serial = {}, {}

    def flush(role: int):
        number = (task << 32) + (role << 28) + serial.get(role, 0)
        serial[role] = serial.get(role, 0) + 1
        size[role] = 0
        return number, role, *held.pop(role)

    for batch in batches:
        for doc_id, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            ids, texts = held.setdefault(role, ([], []))
            ids.append(doc_id)
            texts.append(text or b"")
            size[role] = size.get(role, 0) + len(text or b"") + 1
            if size[role] >= SLICE_BYTES:
                yield flush(role)
    for role in sorted(held):
        yield flush(role)


def _columns(order: int, *names: str) -> list[str]:
    return [f"{name}{k}" for k in range(order) for name in names]


def _keys(batches: Iterator[pa.RecordBatch], buckets: int, order: int) -> Iterator[pa.RecordBatch]:
    for number, role, _, texts in _slices(batches):
        columns = list(zip(*Slice(texts, order).dealt(buckets), strict=True))
        rows = len(columns[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array([number] * rows, pa.int64()), pa.array([role] * rows, pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["bucket", "slice", "role", *_columns(order, "keys", "n")],
        )


def _added(keys: pd.Series, counts: pd.Series, roles: pd.Series) -> tuple[list[bytes], list[bytes], int, int, int]:
    """For each row: packed totals of its keys over all learned roles, and over the counted role; and sums."""
    parts = [unpacked_keys(x) for x in keys]
    flat, n = np.concatenate(parts), np.concatenate([unpacked_counts(x) for x in counts])
    lengths = np.array([len(x) for x in parts])
    role = np.repeat(roles.to_numpy(), lengths)
    unique, at = np.unique(flat, return_inverse=True)
    base = np.bincount(at, np.where(role == COUNTED, n, 0), len(unique)).astype(np.int64)
    every = base + np.bincount(at, np.where(role == TUNING, n, 0), len(unique)).astype(np.int64)
    cut = np.cumsum(lengths)[:-1]
    packed = lambda x, wanted: [packed_counts(y) if z else b"" for y, z in zip(np.split(x[at], cut), wanted, strict=True)]
    return packed(every, [True] * len(parts)), packed(base, (roles == TUNING).tolist()), int(every.sum()), int(base.sum()), int((every > 0).sum())


def _answers(rows: pd.DataFrame, order: int) -> pd.DataFrame:
    out = {"slice": rows["slice"], "bucket": rows["bucket"], "tokens": 0, "base_tokens": 0, "types": 0}
    sums = {"slice": [-1], "bucket": [rows["bucket"].iloc[0]]}
    for k in range(order):
        out[f"all{k}"], out[f"base{k}"], *found = _added(rows[f"keys{k}"], rows[f"n{k}"], rows["role"])
        sums |= {f"all{k}": [b""], f"base{k}": [b""]}
        if k == 0:
            sums |= {name: [value] for name, value in zip(("tokens", "base_tokens", "types"), found, strict=True)}
    return pd.concat([pd.DataFrame(out), pd.DataFrame(sums)], ignore_index=True)


_TEXTS = "slice bigint, role int, ids array<bigint>, lengths array<bigint>, texts binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, role, ids, texts in _slices(batches):
        packed = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([role], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
            names=["slice", "role", "ids", "lengths", "texts"],
        )


def _opened(texts: pd.DataFrame, answers: pd.DataFrame, kind: str, order: int) -> tuple[np.ndarray, int, Slice, list[np.ndarray]]:
    """(ids, role, slice, totals by order) of a slice that met its answers."""
    row = texts.iloc[0]
    lengths = np.asarray(row["lengths"], np.int64)
    joined = pa.decompress(row["texts"], int(lengths.sum()), codec="zstd", asbytes=True) if lengths.sum() else b""
    ends = np.cumsum(lengths)
    s = Slice([joined[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], order)
    answers = answers.sort_values("bucket")
    counts = [np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(x) for x in answers[f"{kind}{k}"])]) for k in range(order)]
    if len(texts) != 1 or any(len(c) != len(x) for c, x in zip(counts, s.keys, strict=True)):
        raise RuntimeError("a slice met the answers of another one: the input is not the same at each scan")
    return row["ids"], row["role"], s, counts


def frequency_bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 n), the last bucket open."""
    return np.where(n > 0, np.minimum(1 + np.log2(np.maximum(n, 1)).astype(np.int64), LAMBDA_BUCKETS - 1), 0)


def _tuning(texts: pd.DataFrame, answers: pd.DataFrame, tokens: int, types: int, order: int) -> pd.DataFrame:
    """Held-out n-grams of a slice: bucket, the estimates under the counted part, held-out count."""
    names = ["bucket", *(f"f{k}" for k in range(order)), "n"]
    if not len(texts) or not len(answers):
        return pd.DataFrame({c: [] for c in names})
    _, _, s, counts = _opened(texts, answers, "base", order)
    bucket, parts = s.estimates(counts, tokens, types)
    return pd.DataFrame({"bucket": [bucket.astype(np.int8).tobytes()], **{f"f{k}": [parts[k].astype(np.float32).tobytes()] for k in range(order)}, "n": [packed_counts(s.n[-1])]})


def _expected(batches: Iterator[pa.RecordBatch], weights: np.ndarray, uniform: float, order: int) -> Iterator[pa.RecordBatch]:
    """Expected held-out counts that each estimate accounts for, by bucket."""
    size = len(weights)
    sums = np.zeros((size, order + 1))
    for batch in batches:
        for row in batch.to_pylist():
            b = np.frombuffer(row["bucket"], np.int8).astype(np.int64)
            n = unpacked_counts(row["n"])
            parts = [weights[b, k] * np.frombuffer(row[f"f{k}"], np.float32) for k in range(order)] + [weights[b, order] * uniform]
            total = np.maximum(sum(parts), 1e-300)
            for k in range(order + 1):
                sums[:, k] += np.bincount(b, n * parts[k] / total, size)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(order + 1))], names=["bucket", *(f"s{k}" for k in range(order + 1))])


def _scores(texts: pd.DataFrame, answers: pd.DataFrame, weights: np.ndarray, tokens: int, types: int, order: int) -> pd.DataFrame:
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    if not len(texts):
        return pd.DataFrame({c: [] for c in columns})
    ids, role, s, counts = _opened(texts, answers, "all", order)
    n, words = len(ids), counts[0]
    base = np.log10((words + 0.1) / (tokens + 0.1 * (types + 1)))[s.at[0]]
    bucket, parts = s.estimates(counts, tokens, types)
    p = sum(weights[bucket, k] * parts[k] for k in range(order + 1)) if tokens else np.ones(len(bucket))
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], dtype="Int64"), "held_out": role == HELD_OUT, "n_tokens": np.bincount(s.doc, minlength=n), "n_known": np.bincount(s.doc[words[s.at[0]] > 0], minlength=n),
            "base_score": np.bincount(s.doc, base, n), "score": np.bincount(s.doc, np.log10(p)[s.at[-1]], n),
        }
    )


def score_texts(docs: DataFrame, held_out: Column, tuning: Column, rounds: int = 12, tolerance: float = 1e-4, order: int = ORDER) -> DataFrame:
    """Model and base scores of every (doc_id, text) row, learned from the rows that ``held_out`` leaves.

    ``tuning``: which of the learned rows the mixture weights are learned from; ``order``: 2 or 3.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    role = F.when(held_out, HELD_OUT).when(tuning, TUNING).otherwise(COUNTED).cast("int")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), role.alias("role"), F.col("text").cast("string").alias("text"))
    if not same_each_scan(rows):
        rows = shared_table(rows, "lm-input")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-int(size) // BUCKET_BYTES))
    kinds = lambda names: ", ".join(f"{c} binary" for c in names)
    asked = rows.mapInArrow(lambda b: _keys(b, buckets, order), "bucket int, slice bigint, role int, " + kinds(_columns(order, "keys", "n")))
    replies = f"slice bigint, bucket int, tokens bigint, base_tokens bigint, types bigint, {kinds(_columns(order, 'all', 'base'))}"
    answers = shared_table(asked.groupBy("bucket").applyInPandas(lambda x: _answers(x, order), replies), "lm-answers")
    tokens, base_tokens, types = (int(x or 0) for x in answers.filter("slice = -1").agg(F.sum("tokens"), F.sum("base_tokens"), F.sum("types")).first())
    replies = answers.filter("slice >= 0").drop("tokens", "base_tokens", "types")
    of_all, of_base = (replies.select("slice", "bucket", *(f"{kind}{k}" for k in range(order))) for kind in ("all", "base"))

    tuned = (
        rows.filter(F.col("role") == TUNING).mapInArrow(_texts, _TEXTS).groupBy("slice")
        .cogroup(of_base.filter(F.shiftright("slice", 28).bitwiseAND(F.lit(15)) == TUNING).groupBy("slice"))
        .applyInPandas(lambda a, b: _tuning(a, b, base_tokens, types, order), kinds(["bucket", *(f"f{k}" for k in range(order)), "n"]))
    )
    tuned = shared_table(tuned, "lm-tuning")
    weights = first_weights(order)
    sums = ["bucket int", *(f"s{k} double" for k in range(order + 1))]
    for _ in range(rounds):
        now = weights.copy()
        found = tuned.mapInArrow(lambda b: _expected(b, now, 1.0 / (types + 1), order), ", ".join(sums))  # noqa: B023
        for r in found.groupBy("bucket").agg(*(F.sum(f"s{k}") for k in range(order + 1))).collect():
            total = sum(r[1:])
            if total > 0:
                weights[r[0]] = np.array(r[1:]) / total
        if np.abs(weights - now).max() < tolerance:
            break
    forget(tuned)
    scored = (
        rows.mapInArrow(_texts, _TEXTS).groupBy("slice").cogroup(of_all.groupBy("slice"))
        .applyInPandas(lambda a, b: _scores(a, b, weights, tokens, types, order), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))


def tuning_part(column: str = "doc_id", divisor: int = 10) -> Column:
    """About a tenth of the ids, chosen independently of the remainder of their crc32."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor)) == 0


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores learned from the documents whose crc32(doc_id as text) mod 10 is not 0."""
    return score_texts(docs, remainder("doc_id", 10) == 0, tuning_part())
