"""Quality classifier: a sparse rule ensemble over document statistics.

Small boosted trees are grown on the statistics of labelled documents; every path from a root
is a rule, a conjunction of comparisons. A logistic model with a lasso penalty is fitted over the
rules, which leaves few of them with a weight, and those are compiled into one Spark column
expression, so that scoring is generated code over the statistics.

The labelled rows that are fitted are bounded (``sample``, the first by a hash of their id);
statistics and scores cover every document and its whole text.

Defined results: a null text is an empty one and is scored; null labels are ignored; of repeated
labels the mean decides, a tie for 1; without labels of both classes the score is the share of
label 1, or 0.5 if there is none; repeated rows are scored each; an empty table gives no rows; a column of ``docs`` that
has the name of the score or of a statistic raises an error (``common.plain_names`` renames columns first).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, combine, labelled_rows, span_hashes
from .line_rules import _repeated_words

SAMPLE = 20_000
"""Labelled rows that are fitted, at most."""

STATISTICS = (
    "words", "bytes", "word_bytes", "symbols", "upper", "capitals", "marks", "bars", "punctuation", "digits", "high_bytes",
    "distinct", "echoes", "repeated", "same_lines", "line_words", "short_lines", "long_words", "short_words", "links",
)
PREFIX = "_stat_"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _BARS, _MARKS = _table(b"#*$%&|<>{}[]\\^~_=+@"), _table(b"|"), _table(b"!?")
_PUNCT, _DIGITS, _UPPER, _LINKS = _table(b".,;:!?\"'()-"), _table(b"0123456789"), _table(bytes(range(65, 91))), _table(b"/")
_LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def measure(texts: list[bytes]) -> np.ndarray:
    """Statistics of each text, one column for each of STATISTICS."""
    w = Words(texts)
    data, n = w.data, np.maximum(w.count, 1)
    hashes = w.hashes()
    size = np.diff(w.bounds) - 1
    letters = np.maximum(w.per_text(_LETTERS[data]), 1)
    lengths = w.ends - w.starts
    per_word = lambda flags: np.bincount(w.doc[flags], minlength=w.n) / n
    keyed = combine(hashes, w.doc.astype(np.uint64)) if len(hashes) else hashes
    distinct = np.bincount(w.doc[np.unique(keyed, return_index=True)[1]], minlength=w.n) if len(hashes) else np.zeros(w.n)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = keyed[1:] == keyed[:-1]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    full = last > first
    doc = w.doc[first[full]]
    lines = np.maximum(np.bincount(doc, minlength=w.n), 1)
    line_keys = combine(span_hashes(data, starts[full], ends[full]), doc.astype(np.uint64)) if full.any() else np.zeros(0, np.uint64)
    unique_lines = np.bincount(doc[np.unique(line_keys, return_index=True)[1]], minlength=w.n)
    capital = _UPPER[data[w.starts]] & _UPPER[data[np.minimum(w.starts + 1, len(data) - 1)]]
    return np.column_stack(
        [
            w.count, size, (w.per_text(_LETTERS[data]) / n), w.per_text(_SYMBOLS[data]) / n, w.per_text(_UPPER[data]) / letters, per_word(capital),
            w.per_text(_MARKS[data]) / n, w.per_text(_BARS[data]) / n, w.per_text(_PUNCT[data]) / n, w.per_text(_DIGITS[data]) / n, w.per_text(data >= 128) / letters,
            distinct / n, per_word(echo), _repeated_words(w, hashes) / n, 1 - unique_lines / lines, w.count / lines,
            np.bincount(doc[(last - first)[full] < 4], minlength=w.n) / lines, per_word(lengths > 16), per_word(lengths < 4), w.per_text(_LINKS[data]) / n,
        ]
    ).astype(np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, *(pa.array(np.ascontiguousarray(c)) for c in found.T)],
                names=[*piece.schema.names, *(PREFIX + s for s in STATISTICS)],
            )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a column for each statistic of ``text``; all other columns pass through."""
    if taken := sorted({(PREFIX + s).lower() for s in STATISTICS} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns {taken} are there already")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(PREFIX + s, T.DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(_measured, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, only: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the rows to fit, in a reproducible order."""
    columns = [PREFIX + s for s in STATISTICS]
    rows = with_statistics(labelled_rows(docs, labels, label, sample, only)).select("doc_id", label, *columns).toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", *columns])
    return rows[columns].to_numpy(np.float64), rows[label].to_numpy(np.float64)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, at in self.terms:
            c = F.col(PREFIX + STATISTICS[k])
            out = out & (c > at if above else c <= at)
        return out


def _grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, terms: tuple, rules: list, least: int) -> tuple:
    """A regression tree on the logistic loss; each node below the root adds its path to ``rules``."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    value = -g / (h + 1.0)
    if terms:
        rules.append(Rule(terms))
    if depth == 0 or len(rows) < 2 * least:
        return ("leaf", value)
    best = (1e-6, None, None)
    for k, edges in enumerate(bins):
        if not len(edges):
            continue
        b, m = binned[rows, k], len(edges) + 1
        gs, hs, ns = np.cumsum(np.bincount(b, gradient[rows], m))[:-1], np.cumsum(np.bincount(b, hessian[rows], m))[:-1], np.cumsum(np.bincount(b, minlength=m))[:-1]
        gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], k, at)
    if best[1] is None:
        return ("leaf", value)
    _, k, at = best
    edge, low = float(bins[k][at]), binned[rows, k] <= at
    parts = [
        _grow(x, bins, binned, rows[side], gradient, hessian, depth - 1, (*terms, (k, above, edge)), rules, least)
        for side, above in ((low, False), (~low, True))
    ]
    return ("split", k, edge, *parts)


def _leaf_values(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    _, k, edge, low, high = tree
    return np.where(x[:, k] <= edge, _leaf_values(low, x), _leaf_values(high, x))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    rng, n = np.random.default_rng(seed), len(x)
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 48))) for k in range(x.shape[1])]
    bins = [edges[:-1] if len(edges) and edges[-1] >= x[:, k].max() else edges for k, edges in enumerate(bins)]
    binned = np.column_stack([np.searchsorted(edges, x[:, k], side="left") for k, edges in enumerate(bins)])
    margin, rules = np.full(n, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(n)[: max(n // 2, min(n, 200))])
        tree = _grow(x, bins, binned, rows, p - y, p * (1 - p), depth, (), rules, max(5, n // 500))
        margin += rate * _leaf_values(tree, x)
    return list(dict.fromkeys(rules))


def lasso_logistic(features: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights, by accelerated proximal gradient steps."""
    n, k = features.shape
    x = np.column_stack([np.ones(n), features])
    v = np.ones(k + 1)
    for _ in range(12):  # the largest eigenvalue of x'x/n bounds the curvature
        v = x.T @ (x @ v) / n
        top = np.linalg.norm(v)
        v /= top
    step = 4 / (top * 1.05)
    w = z = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        moved = z - step * (x.T @ (p - y)) / n
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = moved + (momentum - 1) / after * (moved - w)
        w, momentum = moved, after
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[float, ...]
    rules: tuple[Rule, ...]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005, **growth) -> RuleEnsemble:
        if not len(y):
            return RuleEnsemble(0.0, (), ())
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        if y.min() == y.max():
            return RuleEnsemble(float(np.log(share / (1 - share))), (), ())
        rules = grow_rules(x, y, **growth)
        held, kept = {}, []
        for rule in rules:  # rules that hold on the same rows count once
            key = np.packbits(rule.holds(x)).tobytes()
            if key not in held:
                held[key] = rule
                kept.append(rule)
        if not kept:
            return RuleEnsemble(float(np.log(share / (1 - share))), (), ())
        intercept, weights = lasso_logistic(np.column_stack([r.holds(x) for r in kept]).astype(np.float64), y, penalty)
        live = np.flatnonzero(np.abs(weights) > 1e-9)
        return RuleEnsemble(intercept, tuple(float(weights[k]) for k in live), tuple(kept[k] for k in live))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for w, rule in zip(self.weights, self.rules, strict=True):
            margin = margin + np.where(rule.holds(x), w, 0.0)
        return 1 / (1 + np.exp(-margin))

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        margin = F.lit(self.intercept)
        for w, rule in zip(self.weights, self.rules, strict=True):
            margin = margin + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, only: Column | None = None) -> RuleEnsemble:
    """Fit on documents that ``labels`` marks; ``only``: which of their ids may be learned from."""
    return RuleEnsemble.fit(*labelled(docs, labels, label, sample, only))


def with_quality(docs: DataFrame, model: RuleEnsemble, score: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text."""
    if score.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {score} is there already")
    return with_statistics(docs).withColumn(score, model.column()).drop(*(PREFIX + s for s in STATISTICS))
