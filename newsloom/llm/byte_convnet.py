"""Language ID: a byte convolutional network, trained in numpy, applied to fixed-length windows.

Bytes are embedded, filters of several widths slide over a window, each filter's maximum is pooled,
and a softmax over the pooled values gives the languages. A text is cut into windows of a fixed
length, all of it; its languages' probabilities are the windows' mean, weighted by their letters.

For prediction the first layer is folded into tables: what a pair of neighbouring bytes adds to each
filter is looked up, so a window costs a few gathers for each byte, and no memory beyond a block.

Training takes a bounded sample: ``per_language`` documents of each language, by the hash of their id,
and ``windows_each`` windows of each. Prediction covers every document.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if
no language was learned; ties go to the language that comes first; repeated rows are predicted each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, texts_of

LENGTH = 128
WIDTHS = (2, 3, 4)
PER_LANGUAGE = 1000
WINDOWS_EACH = 3
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, lower-cased and padded with zero bytes, and the text of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // length))
    out = np.zeros(int(counts.sum()) * length, np.uint8)
    starts = (np.cumsum(counts) - counts) * length
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(data)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out[at] = _LOWER[data]
    return out.reshape(-1, length), np.repeat(np.arange(len(texts)), counts)


@dataclass(frozen=True)
class ByteConvNet:
    languages: tuple[str, ...]
    embedding: np.ndarray  # (256, e)
    filters: tuple[np.ndarray, ...]  # (width * e, f) each
    biases: tuple[np.ndarray, ...]
    out: np.ndarray  # (widths * f, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Of each width, (offset, table) with a row of filter values for each pair of bytes, or byte."""
        e, all_tables = self.embedding.shape[1], []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embedding @ w[k * e : (k + 1) * e]).astype(np.float32) for k in range(width)]
            parts = []
            for k in range(0, width - 1, 2):
                parts.append((k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1)))
            if width % 2:
                parts.append((width - 1, single[-1]))
            all_tables.append(parts)
        return all_tables

    def probabilities(self, windows: np.ndarray, tables: list | None = None, block: int = 256) -> np.ndarray:
        tables = tables or self.tables()
        result = np.empty((len(windows), len(self.languages)), np.float32)
        for begin in range(0, len(windows), block):
            x = windows[begin : begin + block]
            pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for width, parts, bias in zip(WIDTHS, tables, self.biases, strict=True):
                span = x.shape[1] - width + 1
                total = None
                for offset, table in parts:
                    index = pairs[:, offset : offset + span] if len(table) > 256 else x[:, offset : offset + span]
                    got = np.take(table, index, axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(np.maximum(total.max(axis=1) + bias, 0))  # the ramp is monotone: pool first
            z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            result[begin : begin + block] = z / z.sum(axis=1, keepdims=True)
        return result

    def predict(self, texts: list[bytes], tables: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the language or -1, score) of each text."""
        windows, doc = windows_of(texts)
        letters = _LETTER[windows].sum(axis=1)
        weight = np.bincount(doc, letters, len(texts))
        live = letters > 0
        p = np.zeros((len(texts), len(self.languages)))
        got = self.probabilities(windows[live], tables)
        for k in range(len(self.languages)):
            p[:, k] = np.bincount(doc[live], got[:, k] * letters[live], len(texts))
        p /= np.maximum(weight, 1)[:, None]
        best = p.argmax(axis=1)
        known = np.array([_has_letter(t) for t in texts], bool)
        return np.where(known, best, -1), np.where(known, np.clip(p[np.arange(len(texts)), best], 0, 1), 0.0)


def _has_letter(text: bytes) -> bool:
    return text.lower() != text.upper() or any(c.isalpha() for c in text.decode("utf-8"))


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], embedding: int = 6, filters: int = 16, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
    """Adam on the cross entropy; the gradient of a pooled value goes to the place of its maximum."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.5, (256, embedding))]
    for width in WIDTHS:
        params += [rng.normal(0, 1 / np.sqrt(width * embedding), (width * embedding, filters)), np.zeros(filters)]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))), np.zeros(len(languages))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), batch):
            rows = order[begin : begin + batch]
            x, y = windows[rows], labels[rows]
            n = len(rows)
            embedded = params[0][x]
            pooled, places, patches = [], [], []
            for k, width in enumerate(WIDTHS):
                span = x.shape[1] - width + 1
                patch = np.concatenate([embedded[:, j : j + span] for j in range(width)], axis=2)
                z = patch @ params[1 + 2 * k] + params[2 + 2 * k]
                place = z.argmax(axis=1)
                pooled.append(np.take_along_axis(z, place[:, None, :], axis=1)[:, 0])
                places.append(place)
                patches.append(patch)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            logits = hidden @ params[-2] + params[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = hidden.T @ p + 1e-4 * params[-2], p.sum(axis=0)
            back = (p @ params[-2].T) * (hidden > 0)
            for k, width in enumerate(WIDTHS):
                g = back[:, k * filters : (k + 1) * filters]
                at = patches[k][np.arange(n)[:, None], places[k]]  # (n, filters, width * e)
                grads[1 + 2 * k] = np.einsum("nfd,nf->df", at, g)
                grads[2 + 2 * k] = g.sum(axis=0)
                to_patch = (g[:, :, None] * params[1 + 2 * k].T[None]).reshape(n, filters, width, embedding)
                where = x[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(width)]
                np.add.at(grads[0], where.ravel(), to_patch.reshape(-1, embedding))
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f32 = [q.astype(np.float32) for q in params]
    return ByteConvNet(languages, f32[0], tuple(f32[1 + 2 * k] for k in range(len(WIDTHS))), tuple(f32[2 + 2 * k] for k in range(len(WIDTHS))), f32[-2], f32[-1])


def _training_windows(batches: Iterator[pa.RecordBatch], each: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of each text, windows at random places; every third is a short piece, so that short texts are learned too."""
    for batch in batches:
        ids, langs, found = [], [], []
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            rng = np.random.default_rng([seed, doc_id & 0x7FFFFFFFFFFFFFFF])
            for k in range(each):
                size = int(rng.integers(8, LENGTH)) if k % 3 == 2 else LENGTH
                at = int(rng.integers(0, max(1, len(text) - size + 1)))
                piece = text[at : at + size]
                if any(_LETTER[np.frombuffer(piece, np.uint8)]):
                    ids.append(doc_id)
                    langs.append(lang)
                    found.append(_LOWER[np.frombuffer(piece, np.uint8)].tobytes().ljust(LENGTH, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["doc_id", "lang", "window"])


def fit_languages(docs: DataFrame, only: Column | None = None, per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH, seed: int = 11) -> ByteConvNet | None:
    """A network for the languages of (doc_id, lang, text) rows; None if there are none. ``only``: which rows may be learned from."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    if only is not None:
        rows = rows.filter(only)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    # of a frequent language only rows that can be among the first are ranked: about four times as many as are taken
    each = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    early = rows.select("doc_id", "lang", place.alias("place")).join(each, "lang").filter(F.col("place") * F.col("rows") <= F.lit(4.0 * per_language * (1 << 40)))
    picked = early.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(lambda b: _training_windows(b, windows_each, seed), "doc_id bigint, lang string, window binary")
    found = sample.toArrow().to_pandas().sort_values(["doc_id", "lang", "window"], ignore_index=True)
    if not len(found):
        return None
    languages = tuple(sorted(found["lang"].unique()))
    x = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, LENGTH)
    return train(x, np.searchsorted(np.array(languages), found["lang"].to_numpy(str)), languages, seed=seed)


def _predicted(batches: Iterator[pa.RecordBatch], model: ByteConvNet | None) -> Iterator[pa.RecordBatch]:
    tables = model.tables() if model else None
    names = np.array([*(model.languages if model else ()), UNKNOWN], object)
    for batch in batches:
        for piece, texts in chunks(batch):
            best, score = model.predict(texts, tables) if model else (np.full(len(texts), -1), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(piece.num_columns - 1)), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=[*piece.schema.names[:-1], "lang_pred", "score"])


def predict_languages(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _predicted(b, model), "doc_id bigint, lang_pred string, score double")
