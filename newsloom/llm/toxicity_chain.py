"""Toxicity: a chain of linear models over word and word-beginning features.

Categories are predicted in a fixed order; each model sees the features and the probabilities of
the categories before it. Models after the first are trained on out-of-fold probabilities, so that
a later model does not learn to trust an earlier one more than it will deserve.

Features: words (runs of letters, lower case) and their first 3 to 6 bytes, present or not. All that is learned
is learned from a bounded sample of labelled rows (``sample``): presence counts by label are aggregated in
Spark over it, the ``features`` with the largest association with any label are kept, and the models are
fitted. Whole texts of all documents are scored.

Where a table only says toxic or not, the earlier categories are kinds of toxicity that are learned, too: a mixture of
``kinds`` Bernoulli profiles over the features that go with the label is fitted to the toxic rows by expectation-
maximisation, and a toxic row belongs to the kind it most likely comes from. No word is given.

Defined results: a null or empty text has no features and gets the models' base rates; null labels
are ignored; of repeated labels the mean decides, a tie for 1; a category without both labels is constant;
repeated rows are scored each; an empty table gives no rows; a column of ``docs`` that has the name of a
probability column raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, forget, labelled_rows, mix, shared_table, span_hashes

SAMPLE = 20_000
FEATURES = 4096
FOLDS = 5
BEGINNINGS = (3, 4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def features(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, ordered; only ``known`` (sorted) features if given, then as their ranks."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").decode("utf-8").lower().encode("utf-8"), np.uint8)
    breaks = np.flatnonzero(data == 10)
    # a text may hold line feeds itself; lower-casing may change lengths: bounds by counted breaks
    last = np.cumsum(np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))) - 1
    bounds = breaks[last]
    edge = np.diff(_LETTER[data].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(bounds, starts)
    found, docs = [span_hashes(data, starts, ends)], [doc]
    for k in BEGINNINGS:
        long = ends - starts > k
        # the length is mixed into the hash: a beginning never meets a whole word of the same bytes
        found.append(mix(span_hashes(data, starts[long], starts[long] + k) ^ np.uint64(0x5851F42D4C957F2D)))
        docs.append(doc[long])
    keys, doc = np.concatenate(found), np.concatenate(docs)
    if known is not None:
        sieve = np.zeros(1 << 20, bool)
        sieve[(known >> np.uint64(44)).astype(np.int64)] = True
        maybe = sieve[(keys >> np.uint64(44)).astype(np.int64)]
        keys, doc = keys[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1) if len(known) else np.zeros(len(keys), np.int64)
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        pairs = np.unique(doc[hit] * (1 << 32) + at[hit])
        return pairs >> 32, pairs & 0xFFFFFFFF
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], keys[new]


def _presence(batches: Iterator[pa.RecordBatch], n_labels: int) -> Iterator[pa.RecordBatch]:
    """Presence counts of a slice: (feature, documents, documents with each label)."""
    for batch in batches:
        for piece, texts in chunks(batch, size=2 << 20):
            doc, keys = features(texts)
            unique, at = np.unique(keys, return_inverse=True)
            columns = [np.bincount(at, minlength=len(unique))]
            for k in range(n_labels):
                label = piece.column(1 + k).to_numpy(zero_copy_only=False)
                columns.append(np.bincount(at, weights=label[doc], minlength=len(unique)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)],
                names=["feature", "n", *(f"n{k}" for k in range(n_labels))],
            )


def _known_features(batches: Iterator[pa.RecordBatch], known: np.ndarray, n_labels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch):
            doc, rank = features(texts, known)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k) for k in range(1 + n_labels)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rank.astype(np.int32)))],
                names=["doc_id", *(f"label{k}" for k in range(n_labels)), "ranks"],
            )


def _logistic(rows: np.ndarray, ranks: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-3, rounds: int = 250) -> np.ndarray:
    """Weights of [features, extra, intercept] under a ridge penalty, by Adam on all rows."""
    n, k = len(y), extra.shape[1]
    w, m, v = np.zeros(width + k + 1), np.zeros(width + k + 1), np.zeros(width + k + 1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    for t in range(1, rounds + 1):
        margin = np.bincount(rows, w[:width][ranks], n) + extra @ w[width:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        grad = np.concatenate([np.bincount(ranks, error[rows], width), extra.T @ error, [error.sum()]])
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _probability(w: np.ndarray, rows: np.ndarray, ranks: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    width = len(w) - 1 - extra.shape[1]
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[:width][ranks], n) + extra @ w[width:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class ToxicityChain:
    """Category names in order, the sorted feature hashes, and each category's weights."""

    categories: tuple[str, ...]
    known: np.ndarray
    weights: tuple[np.ndarray, ...]

    @staticmethod
    def fit_rows(categories: tuple[str, ...], known: np.ndarray, rows: np.ndarray, ranks: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> ToxicityChain:
        """From (row, feature rank) pairs and a 0/1 column for each category."""
        n, width = len(labels), len(known)
        fold = np.arange(n) % folds
        earlier, weights = np.zeros((n, 0)), []
        for k in range(len(categories)):
            y = labels[:, k].astype(np.float64)
            weights.append(_logistic(rows, ranks, earlier, y, width))
            if k + 1 < len(categories):
                out = np.zeros(n)
                for f in range(folds):
                    learn = fold != f
                    renumber = np.cumsum(learn) - 1
                    part = learn[rows]
                    w = _logistic(renumber[rows[part]], ranks[part], earlier[learn], y[learn], width, rounds=80)
                    p = _probability(w, rows, ranks, earlier, n)
                    out[~learn] = p[~learn]
                earlier = np.column_stack([earlier, out])
        return ToxicityChain(categories, known, tuple(weights))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text and category, the chain's own earlier ones fed forward."""
        doc, ranks = features(texts, self.known)
        earlier = np.zeros((len(texts), 0))
        for w in self.weights:
            earlier = np.column_stack([earlier, _probability(w, doc, ranks, earlier, len(texts))])
        return earlier


def kinds_of(rows: np.ndarray, ranks: np.ndarray, toxic: np.ndarray, width: int, kinds: int, profile: int = 256, rounds: int = 60) -> np.ndarray:
    """A 0/1 column for each kind: the toxic rows that most likely come from its Bernoulli profile, larger kinds first.

    Profiles are over the ``profile`` features with the largest excess in toxic rows. The first profiles are those
    of rows with, and without, each of the commonest of them, so the result is the same each time.
    """
    out = np.zeros((len(toxic), kinds), np.int64)
    which = np.flatnonzero(toxic == 1)
    if not len(which):
        return out
    n, n_toxic = np.bincount(ranks, minlength=width), np.bincount(ranks, toxic[rows], minlength=width)
    excess = n_toxic - n * toxic.mean()
    chosen = np.sort(np.argsort(-excess, kind="stable")[:profile])
    chosen = chosen[excess[chosen] > 0]
    at = np.full(width, -1)
    at[chosen] = np.arange(len(chosen))
    row_at = np.full(len(toxic), -1)
    row_at[which] = np.arange(len(which))
    keep = (row_at[rows] >= 0) & (at[ranks] >= 0)
    x = np.zeros((len(which), len(chosen)))
    x[row_at[rows[keep]], at[ranks[keep]]] = 1
    belongs = np.full((len(which), kinds), 1 / kinds)
    for k, feature in enumerate(np.argsort(-x.sum(0), kind="stable")[: kinds - 1]):
        has = x[:, feature] == 1
        belongs[has] *= 0.1
        belongs[has, k] = 1
        belongs /= belongs.sum(1, keepdims=True)
    for _ in range(rounds):
        share = (belongs.sum(0) + 1) / (len(which) + kinds)
        p = (belongs.T @ x + 0.5) / (belongs.sum(0)[:, None] + 1)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        logs = np.log(share) + x @ np.log(p).T + (1 - x) @ np.log(1 - p).T
        after = np.exp(logs - logs.max(1, keepdims=True))
        after /= after.sum(1, keepdims=True)
        settled = np.abs(after - belongs).max() < 1e-6
        belongs = after
        if settled:
            break
    best = belongs.argmax(1)
    order = np.argsort(-np.bincount(best, minlength=kinds), kind="stable")
    for k, kind in enumerate(order):
        out[which[best == kind], k] = 1
    return out


def fit_toxicity(rows: DataFrame, categories: list[str], width: int = FEATURES, min_documents: int = 5, kinds: int = 0) -> ToxicityChain:
    """Fit the chain on (doc_id, text, a 0/1 column for each category in order), a bounded labelled sample.

    ``kinds``: so many categories of the last one are learned and come before all others, as ``kind1`` and so on.
    """
    names = [f"_y{k}" for k in range(len(categories))]
    rows = shared_table(
        rows.select("doc_id", *(F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)), "text").dropna(subset=names), "toxicity-labelled"
    )
    counts = rows.mapInArrow(
        lambda b: _presence(b, len(names)), "feature bigint, n bigint, " + ", ".join(f"n{k} bigint" for k in range(len(names)))
    ).groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))))
    totals = rows.agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in names)).first()
    total = max(totals["n"], 1)
    strength = F.greatest(
        F.lit(0.0),
        *(
            # the label's log likelihood ratio with and without the feature, signed by neither
            F.abs(F.log((F.col(f"n{k}") + 0.1) / (F.col("n") + 0.2) / F.lit(((totals[x] or 0) + 0.1) / (total + 0.2)))) * F.sqrt(F.col("n"))
            for k, x in enumerate(names)
        ),
    )
    top = counts.filter(F.col("n") >= min_documents).select("feature", strength.alias("strength")).orderBy(F.desc("strength"), "feature").limit(width)
    known = np.sort(np.array([r["feature"] for r in top.collect()], np.int64).view(np.uint64))
    vectors = rows.mapInArrow(
        lambda b: _known_features(b, known, len(names)), "doc_id bigint, " + ", ".join(f"label{k} int" for k in range(len(names))) + ", ranks array<int>"
    ).toArrow()
    forget(rows)
    vectors = vectors.sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = vectors.column("ranks")
    ranks, lengths = (np.concatenate([np.zeros(0, np.int64), *(f(c) for c in lists.chunks)]) for f in (lambda c: c.flatten().to_numpy(), lambda c: np.diff(c.offsets.to_numpy())))
    y = np.column_stack([vectors.column(f"label{k}").to_numpy() for k in range(len(names))]).astype(np.int64)
    del vectors, lists
    names = (*(f"kind{k + 1}" for k in range(kinds)), *categories)
    if not len(y):
        return ToxicityChain(names, known, tuple(np.concatenate([np.zeros(len(known) + k), [-9.0]]) for k in range(len(names))))
    at = np.repeat(np.arange(len(y)), lengths.astype(np.int64))
    if kinds:
        y = np.column_stack([kinds_of(at, ranks, y[:, -1], len(known), kinds), y])
    return ToxicityChain.fit_rows(names, known, at, ranks, y)


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityChain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch):
            p = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))],
                names=[*piece.schema.names, *(f"_p_{c}" for c in model.categories)],
            )


def with_toxicity(docs: DataFrame, model: ToxicityChain) -> DataFrame:
    """``docs`` with a probability column ``_p_<category>`` for each category; other columns pass through."""
    names = [f"_p_{c}" for c in model.categories]
    if taken := sorted({n.lower() for n in names} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns {taken} are there already")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(lambda b: _scored(b, model), schema)


KINDS = 2


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, only=None, kinds: int = KINDS) -> ToxicityChain:
    """The chain of ``kinds`` learned kinds and ``toxic``, from a table that marks documents as toxic or not."""
    return fit_toxicity(labelled_rows(docs, labels, "toxic", sample, only), ["toxic"], kinds=kinds)
