"""N-gram Jaccard join with set-relation skipping: links between near-duplicate texts, exactly.

A document's set holds its distinct 3-word shingles (64-bit hashes). Equal sets are one node from
the start. Two sets link when ``den * |x & y| >= num * |x | y|``.

*Index.* Sets are ordered by a total order of shingles, and only a prefix is posted: two sets that
link share a shingle of both prefixes, whatever the order is. The order is by region, class and hash.
The first region is the quarter of the hashes that are smallest: it holds more than a prefix of nearly
every set, so only that window of a set is kept and counted (sets with fewer keep all they have).
The classes go from shingles of one set to frequent ones and come from exact counts, joined to the
windows: prefixes are filled with shingles that need no posting, and passages that many documents
share stay out of them at every size of the input.

*Index-level skipping.* Each list is sorted by set size, then position. A probe jumps over the rest of
a size block as soon as a position leaves too few shingles to reach the overlap that the two sizes
ask for, and leaves the list when its own position, or the sizes, rule out all that follows.

*Answer-level skipping.* Of each list, first only the most central set (the smallest position) is
compared with the others; where a list is dealt over salts, then the most central of all its parts with those of other components. A set that is found linked to a better connected one takes that set as its
representative, and its own answers are derived from the representative's: a set x with p shingles
that its representative r lacks has |x & z| <= |r & z| + p for every z. So lists are walked by
representative, one entry for all the sets it stands for; of two representatives the overlap is computed once, and
only where that answer, widened by the differences, still allows a link are the sets behind them
looked at, in the lists that they share, and computed if the answer widened by their own differences allows it.
Sets of one component need no answer. Before an overlap is computed, a parity sketch of each set bounds its
difference from the other.

That gives components. ``all_links`` answers every pair of different sets: the pivot of each list is
compared with all of it, and the answers of the sets similar to it follow incrementally from the
differences: with M the shingles that a set lacks of the pivot y and P those it has beside it,
|x & z| = |y| - |Mx| - |Mz| + |Mx & Mz| + |Px & Pz|. Only pairs with a set far from the pivot that the bounds
leave open are computed from whole sets.

Lists of frequent shingles are dealt over salts, one for about ``LIST`` sets, and open lists of
representatives over blocks of ``BLOCK`` entries that meet pairwise, so a task never holds a whole hot list. A
filter of bounded size spares most of the texts that are not compared a shuffle; what it lets
through is joined exactly. Nothing else is collected or broadcast.

Defined results: a text without words, or null, has an empty set and links with nothing; a text of
fewer than 3 words has its word sequence as its one shingle; rows without a doc_id take no part and
have no component; rows that repeat a doc_id are nodes of their own text; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, chunks, combine, forget, mix, shared_table, span_hashes
from .components import components

CLASSES = (2, 5, 25)
"""Windows that must hold a shingle for each next class; shingles of the last are frequent."""
REGION = 1 << 62
"""Hashes below it are the first region."""
FILTER_BITS = 1 << 25
"""A filter has 8 bits for each entry, and no more than these (4 MB)."""
LIST = 1024
"""Sets of a frequent shingle that share a salt, about."""
BLOCK = 2048
"""Entries of an open list that meet in one cell with as many others."""


@dataclass(frozen=True)
class Threshold:
    num: int = 90
    den: int = 100

    def prefix(self, n):
        """Postings of a set of n shingles: n - ceil(t n) + 1."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """The least common shingles of two linked sets of these sizes: ceil(t / (1 + t) (a + b))."""
        return -(-self.num * (a + b) // (self.num + self.den))


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and where each text's begin."""
    w = Words(texts, lower=True)
    h = w.hashes()
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    keys, doc = [], []
    if len(h) >= n:
        at = np.flatnonzero(w.doc[n - 1 :] == w.doc[: len(w.doc) - n + 1])
        keys.append(combine(*(h[at + k] for k in range(n))))
        doc.append(w.doc[at])
    if len(short):
        keys.append(mix(span_hashes(h, w.first[short], w.first[short + 1])))
        doc.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(w.n + 1, np.int64)
    key, doc = np.concatenate(keys), np.concatenate(doc)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.n))))


def _set_ids(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return mix(span_hashes(key, bounds[:-1], bounds[1:]) ^ np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.view(np.int64)))


def _heads(bounds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the first lengths[k] values from bounds[k] on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(bounds[:-1], lengths)


def _narrow(batches: Iterator[pa.RecordBatch], t: Threshold, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch):
            key, bounds = shingle_sets(texts, width)
            n = np.diff(bounds)
            # keys are sorted: those of the first region come first
            owner = np.repeat(np.arange(len(n)), n)
            near = np.bincount(owner[key < np.uint64(REGION)], minlength=len(n))
            lengths = np.where(near >= np.where(n > 0, t.prefix(n), 0), near, n)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(_set_ids(key, bounds)), pa.array(n.astype(np.int64)), pa.array(near.astype(np.int64)), _lists(key[_heads(bounds, lengths)], lengths)],
                names=["doc_id", "text_key", "sid", "n", "near", "window"],
            )


def _whole_sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(sid, n, keys) of rows whose id hash is in the filter."""
    for batch in batches:
        batch = batch.filter(pa.array(_in_filter(batch.column(0).to_numpy(zero_copy_only=False), wanted)))
        for _, texts in chunks(batch):
            key, bounds = shingle_sets(texts, width)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(_set_ids(key, bounds)), pa.array(n.astype(np.int64)), _lists(key, n)], names=["sid", "n", "keys"])


SKETCH_BITS = 4096


def _sketches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(sid, n, sketch) of rows whose id hash is in the filter: the parity of the shingles on each bit.

    A shingle that only one of two sets holds flips one bit, so the bits in which two sketches differ
    are no more than the shingles in which the sets do.
    """
    for batch in batches:
        batch = batch.filter(pa.array(_in_filter(batch.column(0).to_numpy(zero_copy_only=False), wanted)))
        for _, texts in chunks(batch, size=1 << 18):
            key, bounds = shingle_sets(texts, width)
            n = np.diff(bounds)
            place = np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (key >> np.uint64(64 - 12)).astype(np.int64)
            odd = (np.bincount(place, minlength=len(n) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(n), SKETCH_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_set_ids(key, bounds)), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in np.packbits(odd, axis=1)], pa.binary())], names=["sid", "n", "sketch"]
            )


# --- filters of fixed size -----------------------------------------------------------------------


def _places(hashed: Column, bits: int) -> Column:
    return F.array(hashed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1)))


def _filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes: at most FILTER_BITS / 64 words come to the driver."""
    bits = min(FILTER_BITS, 1 << max(16, (8 * hashes.count()).bit_length()))
    place = hashes.select(F.explode(_places(F.col(column), bits)).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("mask"))
    found = words.toArrow()  # columns, not row objects
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _in_filter(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys
    last = np.uint64(len(words) * 64 - 1)
    hit = np.ones(len(keys), bool)
    for place in (keys & last, (keys >> np.uint64(32)) & last):
        hit &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return hit


# --- lists ---------------------------------------------------------------------------------------


def skipping_pairs(start: np.ndarray, stop: np.ndarray, low: np.ndarray, left: np.ndarray, t: Threshold, high: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list that sizes and positions allow, by block skipping.

    Entries are sorted by list, ``low`` and, descending, ``left``; entry k meets those from start[k] up to
    stop[k]. ``low``, ``high``: the sizes of the sets that an entry stands for; ``left``: the most shingles that
    one of them has from its position in the list on.
    """
    high = low if high is None else high
    live = np.flatnonzero(start < stop)
    at = start[live]
    # the next size block of the list from each entry on
    change = np.ones(len(low), bool)
    change[:-1] = (low[1:] != low[:-1]) | (stop[1:] != stop[:-1])
    edges = np.flatnonzero(change)
    block_end = edges[np.searchsorted(edges, np.arange(len(low)))] + 1 if len(low) else np.zeros(0, np.int64)
    while len(live):
        need = t.overlap(low[live], low[at])
        # sizes only grow from here: a probe that can't reach the overlap now can't later
        able = (left[live] >= need) & (high[live] * t.den >= low[at] * t.num)
        fits = left[at] >= need
        emit = able & fits
        if emit.any():
            yield live[emit], at[emit]
        after = np.where(fits, at + 1, block_end[at])
        stay = able & (after < stop[live])
        live, at = live[stay], after[stay]


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of whole runs of equal keys, over batches of a sorted partition."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in columns}
        if not len(held[columns[0]]):
            continue
        last = np.ones(len(held[columns[0]]), bool)
        for k in keys:
            last &= held[k] == held[k][-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield {c: x[:cut] for c, x in held.items()}
            held = {c: x[cut:] for c, x in held.items()}
    if held is not None and len(held[columns[0]]):
        yield held


def _list_bounds(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate((np.flatnonzero(new), [len(new)]))


def _central_pairs(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """Of each list (token, salt, band of sizes; sorted by position) the pairs with its first entry. A list is walked as a stream."""
    pivot: tuple | None = None
    for batch in batches:
        x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("token", "salt", "band", "sid", "n", "pos")}
        if not len(x["token"]):
            continue
        bounds = _list_bounds([x["token"], x["salt"], x["band"]])
        first = np.repeat(bounds[:-1], np.diff(bounds))
        sid, n, pos = x["sid"][first].copy(), x["n"][first].copy(), x["pos"][first].copy()
        head = (x["token"][0], x["salt"][0], x["band"][0])
        if pivot is not None and pivot[0] == head:
            here = first == 0
            sid[here], n[here], pos[here] = pivot[1:]
        end = bounds[-2]
        pivot = ((x["token"][-1], x["salt"][-1], x["band"][-1]), sid[end], n[end], pos[end])
        small, large = np.minimum(n, x["n"]), np.maximum(n, x["n"])
        need = t.overlap(small, large)
        keep = (sid != x["sid"]) & (n - pos >= need) & (x["n"] - x["pos"] >= need) & (small * t.den >= large * t.num)
        if keep.any():
            yield _pairs(sid[keep], x["sid"][keep])


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])


def _cells(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each entry's partners begin and end, and sides: entries of one side of a cell of two blocks do not meet."""
    bounds = _list_bounds([x["token"], x["i"], x["j"]])
    stop = np.repeat(bounds[1:], np.diff(bounds))
    own = np.arange(len(stop))
    return own + 1, stop, np.where(x["i"] == x["j"], -1 - own, x["block"])


def _open_pairs(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """Pairs of representatives of different components within cells, walked with block skipping, that sketches allow."""
    for x in _runs(batches, ["token", "i", "j", "block", "rep", "size", "low", "high", "left", "extra", "component", "sketch"], ["token", "i", "j"]):
        start, stop, side = _cells(x)
        sketch = np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(len(stop), -1)
        for p, q in skipping_pairs(start, stop, x["low"], x["left"], t, x["high"]):
            apart = (side[p] != side[q]) & (x["component"][p] != x["component"][q])
            p, q = p[apart], q[apart]
            for k in range(0, len(p), 8192):
                u, v = p[k : k + 8192], q[k : k + 8192]
                differ = np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1, dtype=np.int64)
                # the most that the representatives, and then any two sets behind them, can share
                most = (x["size"][u] + x["size"][v] - differ) // 2 + x["extra"][u] + x["extra"][v]
                near = most >= t.overlap(x["low"][u], x["low"][v])
                if near.any():
                    yield _pairs(x["rep"][u[near]], x["rep"][v[near]])


def _cell_answers(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    """Of each cell the pairs whose answer follows from the pivot's, and those it leaves open.

    ``common``: shared with the pivot; ``lacks``, ``beside``: the differences of a set that links with the pivot.
    """
    for x in _runs(batches, ["token", "i", "j", "block", "sid", "n", "left", "common", "size", "lacks", "beside"], ["token", "i", "j"]):
        start, stop, side = _cells(x)
        close = np.array([v is not None for v in x["lacks"]])
        for p, q in skipping_pairs(start, stop, x["n"], x["left"], t):
            apart = side[p] != side[q]
            p, q = p[apart], q[apart]
            need = t.overlap(x["n"][p], x["n"][q])
            cp, cq, known = x["common"][p], x["common"][q], (x["common"][p] >= 0) & (x["common"][q] >= 0)
            low = np.where(known, cp + cq - x["size"][p], 0)
            high = np.where(known, np.minimum(cp, cq) + np.minimum(x["n"][p] - cp, x["n"][q] - cq), need)
            proved = low >= need
            left = ~proved & (high >= need)
            for k in np.flatnonzero(left & close[p] & close[q]):
                u, v = p[k], q[k]
                both = low[k] + len(np.intersect1d(x["lacks"][u], x["lacks"][v], assume_unique=True)) + len(np.intersect1d(x["beside"][u], x["beside"][v], assume_unique=True))
                proved[k] = both >= need[k]
                left[k] = False
            keep = proved | left
            if keep.any():
                a, b = x["sid"][p[keep]], x["sid"][q[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(proved[keep])], names=["a", "b", "proved"])


# --- the join ------------------------------------------------------------------------------------


class JaccardJoin:
    """The steps of one join: ``run`` and ``members`` for components, ``answers`` for all links."""

    def __init__(self, docs: DataFrame, threshold: Threshold = Threshold(), width: int = 3):
        self.spark: SparkSession = docs.sparkSession
        self.t, self.width = threshold, width
        text = F.col("text").cast("string")
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
        t = threshold
        #: one row per document: its set, the set's size, and the shingles with the least hashes
        self.narrow = shared_table(
            self.docs.mapInArrow(lambda b: _narrow(b, t, width), "doc_id bigint, text_key bigint, sid bigint, n bigint, near bigint, window array<bigint>"), "join-sets"
        )
        self.there = self.narrow.filter("n > 0 and doc_id is not null")
        #: one row per distinct set, held by its smallest document
        self.sets = shared_table(self.there.groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n")), "join-distinct")
        self.verified: DataFrame | None = None
        #: (sid, component) of sets with links
        self.member: DataFrame | None = None
        self.merged = False

    def _need(self, x: str, y: str) -> Column:
        return F.expr(f"({self.t.num} * ({x} + {y}) + {self.t.num + self.t.den - 1}) div {self.t.num + self.t.den}")

    # postings

    def _whole(self, sids: DataFrame, label: str, read=_whole_sets, schema: str = "sid bigint, n bigint, keys array<bigint>") -> DataFrame:
        """(sid, n, keys) of these sets, or what ``read`` makes of them, from their smallest documents again."""
        held = shared_table(sids.select("sid").distinct().join(self.sets, "sid").select("sid", F.xxhash64("first.doc_id", "first.text_key").alias("h")), "join-held")
        words, width = _filter_of(held, "h"), self.width
        wanted = self.spark.sparkContext.broadcast(words)
        del words
        found = self.docs.select(F.xxhash64("doc_id", "text_key").alias("h"), "text").mapInArrow(lambda b: read(b, wanted.value, width), schema)
        # the filter may let others through, which no pair asks for
        out = shared_table(found.dropDuplicates(["sid"]), label)
        wanted.destroy()
        forget(held)
        return out

    def postings(self) -> DataFrame:
        """(token, sid, n, pos, salt, salts, band) of prefixes, as far as a second set holds the shingle."""
        t = self.t
        windows = shared_table(self.there.groupBy("sid").agg(F.first(F.struct("n", "near", "window")).alias("w")).select("sid", "w.*"), "join-windows")
        tokens = windows.select("sid", "n", "near", F.size("window").alias("size"), F.explode("window").alias("token"))
        counts = shared_table(tokens.groupBy("token").agg(F.count("*").alias("sets")).filter(F.col("sets") >= CLASSES[0]), "join-counts")
        kind = sum((F.col("sets") >= least).cast("int") for least in CLASSES)
        shared = tokens.join(counts, "token").select("token", "sid", "n", "near", "size", ((F.col("token") < 0) | (F.col("token") >= REGION)).alias("far"), kind.alias("kind"), "sets")
        region = Window.partitionBy("sid", "far")
        # shingles that no other set holds come first in their region
        before = F.when(F.col("far"), F.col("size")).otherwise(F.col("near")) - F.count("*").over(region)
        placed = shared.withColumn("pos", before + F.row_number().over(region.orderBy("kind", "token")) - 1).filter(F.col("pos") < F.expr(f"n - ({t.num} * n + {t.den - 1}) div {t.den} + 1"))
        salts = F.when(F.col("kind") == len(CLASSES), F.ceil(F.col("sets") / LIST)).otherwise(0).cast("int")
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(t.den / t.num) if t.num < t.den else 1e-9)) + F.lit(1e-9)).cast("bigint")
        salt = F.when(salts > 0, F.pmod(F.xxhash64("sid"), F.greatest(salts, F.lit(1)))).otherwise(0).cast("int")
        out = shared_table(placed.select("token", "sid", "n", "pos", salt.alias("salt"), salts.alias("salts"), band.alias("band")), "join-postings")
        forget(windows, counts)
        return out

    # answers

    def _verify(self, pairs: DataFrame, differences: bool = False) -> DataFrame | None:
        """(a, b, na, nb, common, linked) of pairs of sets, computed; with what only one of a linked pair holds."""
        pairs = shared_table(pairs.select("a", "b").distinct(), "join-pairs")
        if not pairs.head(1):
            return None
        sets = self._whole(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), "join-compared")
        one, other = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka")), sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
        linked = F.col("common") * (self.t.num + self.t.den) >= (F.col("na") + F.col("nb")) * self.t.num
        met = pairs.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("ka", "kb")).cast("bigint")).withColumn("linked", linked)
        only = [F.when(F.col("linked"), F.array_sort(F.array_except(x, y))).alias(z) for x, y, z in (("ka", "kb", "only_a"), ("kb", "ka", "only_b"))] if differences else []
        found = shared_table(met.select("a", "b", "na", "nb", "common", "linked", *only), "join-answers")
        forget(sets, pairs)
        return found

    def _add(self, pairs: DataFrame) -> None:
        """Compute the pairs that were not yet, and merge the components that they link."""
        if self.verified is not None:
            pairs = pairs.join(self.verified.select("a", "b"), ["a", "b"], "left_anti")
        found = self._verify(pairs)
        if found is None:
            return
        self.verified = found if self.verified is None else self.verified.union(found)
        links = found.filter("linked").select("a", "b")
        if not self.merged:
            self.merged = True
            self.member = shared_table(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("sid"), "component"), "join-member")
            return
        # only components are linked anew
        side = lambda c: self.member.select(F.col("sid").alias(c), F.col("component").alias(f"c{c}"))
        named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
        named = shared_table(named, "join-links")
        moved = components(named.select("u", "v")).select(F.col("node").alias("component"), F.col("component").alias("to"))
        nodes = self.member.union(named.select(F.col("a"), F.col("u")).union(named.select(F.col("b"), F.col("v")))).distinct()
        before, self.member = self.member, shared_table(nodes.join(moved, "component", "left").select("sid", F.coalesce("to", "component").alias("component")), "join-member")
        forget(before, named)

    def links(self) -> DataFrame:
        none = self.spark.createDataFrame([], "u bigint, v bigint")
        return none if self.verified is None else self.verified.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def _representatives(self) -> DataFrame:
        """(sid, rep, shared) of sets that a better connected set stands for, with the shingles that both hold."""
        links = self.verified.filter("linked")
        both = shared_table(links.select(F.col("a").alias("x"), F.col("b").alias("y"), "common").union(links.select("b", "a", "common")), "join-neighbours")
        degree = shared_table(both.groupBy("x").agg(F.count("*").alias("degree")), "join-degrees")
        best = both.join(degree.select(F.col("x").alias("y"), F.col("degree").alias("of_y")), "y").groupBy("x").agg(F.max(F.struct("of_y", "y")).alias("best"))
        leaders = best.join(degree, "x").filter(F.struct("degree", "x") > F.col("best")).select(F.col("x").alias("y"))
        out = shared_table(both.join(leaders, "y").groupBy("x").agg(F.max(F.struct("common", "y")).alias("r")).select(F.col("x").alias("sid"), F.col("r.y").alias("rep"), F.col("r.common").alias("shared")), "join-representatives")
        forget(both, degree)
        return out

    def run(self) -> JaccardJoin:
        t, postings = self.t, self.postings()
        dealt = postings.repartition("token", "salt", "band").sortWithinPartitions("token", "salt", "band", "pos", "n", "sid")
        self._add(dealt.mapInArrow(lambda b: _central_pairs(b, t), "a bigint, b bigint"))
        if self.member is None:
            self.member = self.spark.createDataFrame([], "sid bigint, component bigint")
        dealt_out = postings.filter("salts > 1")
        if dealt_out.head(1):
            self._across_salts(dealt_out)
        opened = self._open(postings, None if self.verified is None else self._representatives())
        forget(postings)
        if opened.head(1):
            self._between(opened)
        forget(opened)
        return self

    def _across_salts(self, postings: DataFrame) -> None:
        """Salts of frequent lists meet: the most central set of all is compared with the rest, as far as they are open."""
        opened = self._open(postings)
        pivots = opened.groupBy("token").agg(F.min(F.struct("pos", "n", "sid", "component")).alias("p")).select("token", F.col("p.sid").alias("pivot"), F.col("p.component").alias("of"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"))
        need = self._need("n", "pn")
        near = (
            opened.join(pivots, "token")
            .filter((F.col("component") != F.col("of")) & (F.col("n") - F.col("pos") >= need) & (F.col("pn") - F.col("pp") >= need))
            .filter(F.least("n", "pn") * self.t.den >= F.greatest("n", "pn") * self.t.num)
        )
        self._add(near.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")))
        forget(opened)

    def _open(self, postings: DataFrame, stands: DataFrame | None = None) -> DataFrame:
        """Postings of lists that hold more than one component, with the components, representatives, and what a set holds beside its own."""
        none = self.spark.createDataFrame([], "sid bigint, rep bigint, shared bigint")
        named = (
            postings.join(self.member, "sid", "left").join(none if stands is None else stands, "sid", "left")
            .select("token", "sid", "n", "pos", F.coalesce("component", "sid").alias("component"), F.coalesce("rep", "sid").alias("rep"), F.coalesce(F.col("n") - F.col("shared"), F.lit(0)).alias("extra"))
        )
        named = shared_table(named, "join-named")
        forget(stands)
        several = named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("token")
        opened = shared_table(named.join(several, "token", "left_semi"), "join-open")
        forget(named)
        return opened

    def _walk(self, entries: DataFrame) -> DataFrame:
        """(a, b) of entries (token, rep, component, low, high, left, extra) of different components that may hold linked sets."""
        t = self.t
        lists = entries.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sketches = self._whole(entries.select(F.col("rep").alias("sid")), "join-sketches", _sketches, "sid bigint, n bigint, sketch binary")
        block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        cells = (
            entries.join(lists, "token").withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
            .join(sketches.select(F.col("sid").alias("rep"), F.col("n").alias("size"), "sketch"), "rep")
        )
        walked = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "low", F.desc("left"), "rep")
        found = shared_table(walked.mapInArrow(lambda b: _open_pairs(b, t), "a bigint, b bigint").distinct(), "join-asked")
        forget(sketches)
        return found

    def _between(self, opened: DataFrame) -> None:
        """Answers between components: of representatives, and of the sets behind them as far as those leave them open."""
        entries = opened.groupBy("token", "rep").agg(F.first("component").alias("component"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"), F.max("extra").alias("extra"))
        asked = self._walk(entries)
        self._add(asked)
        # what the sets behind a representative hold beside it, at the most, and their least size
        behind = shared_table(opened.groupBy("rep").agg(F.max("extra").alias("widest"), F.min("n").alias("low"), (F.count_if(F.col("sid") != F.col("rep")) > 0).alias("others")), "join-behind")
        side = lambda c: behind.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("widest", "low", "others")))
        left = (
            self._apart(asked.join(self.verified.select("a", "b", "common"), ["a", "b"]).join(side("a"), "a").join(side("b"), "b"), "a", "b")
            .filter((F.col("others_a") | F.col("others_b")) & (F.col("common") + F.col("widest_a") + F.col("widest_b") >= self._need("low_a", "low_b")))
            .select("a", "b", "common")
        )
        left = shared_table(left, "join-left")
        if left.head(1):
            reps = left.select(F.col("a").alias("rep")).union(left.select("b")).distinct()
            sets = shared_table(opened.join(reps, "rep", "left_semi"), "join-sets-left")
            named = sets.join(self.member.withColumnRenamed("component", "now"), "sid", "left").select("token", F.col("sid").alias("rep"), F.coalesce("now", "sid").alias("component"), F.col("n").alias("low"), F.col("n").alias("high"), (F.col("n") - F.col("pos")).alias("left"), F.lit(0).alias("extra"))
            possible = self._walk(named)
            # the answer of the two representatives, widened by what these sets hold beside them
            of = lambda c: sets.select(F.col("sid").alias(c), F.col("rep").alias(f"r_{c}"), F.col("n").alias(f"n_{c}"), F.col("extra").alias(f"x_{c}")).distinct()
            told = possible.join(of("a"), "a").join(of("b"), "b").withColumns({"ra": F.least("r_a", "r_b"), "rb": F.greatest("r_a", "r_b")})
            open_ = told.join(left.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "common"), ["ra", "rb"]).filter(F.col("common") + F.col("x_a") + F.col("x_b") >= self._need("n_a", "n_b"))
            self._add(open_.select("a", "b"))
            forget(possible, sets)
        forget(asked, behind, left)

    def _apart(self, pairs: DataFrame, x: str, y: str) -> DataFrame:
        """Rows whose two sets are not of one component."""
        side = lambda c, to: self.member.select(F.col("sid").alias(c), F.col("component").alias(to))
        named = pairs.join(side(x, "_cx"), x, "left").join(side(y, "_cy"), y, "left")
        return named.filter(F.coalesce("_cx", x) != F.coalesce("_cy", y)).drop("_cx", "_cy")

    def answers(self) -> DataFrame:
        """(u, v) of every two different sets that link, each pair once. Not to be called after ``run``."""
        t, postings = self.t, self.postings()
        pivots = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "sid")).alias("p"), F.count("*").alias("sets")).filter("sets > 1").select("token", F.col("p.sid").alias("pivot"), F.col("p.n").alias("size"))
        ends = {"a": F.least("sid", "pivot"), "b": F.greatest("sid", "pivot")}
        listed = shared_table(postings.join(pivots, "token").select("token", "salt", "salts", "sid", "n", "pos", "pivot", "size"), "join-listed")
        forget(postings)
        known = self._verify(listed.filter("sid <> pivot").withColumns(ends), differences=True)
        if known is None:
            return self.links()
        self.verified = known.drop("only_a", "only_b")
        own = F.col("sid") == F.col("pivot")
        told = listed.withColumns(ends).join(known.select("a", "b", "common", "only_a", "only_b"), ["a", "b"], "left").select(
            "token", "salt", "salts", "sid", "n", (F.col("n") - F.col("pos")).alias("left"), "size",
            F.when(own, F.col("n")).otherwise(F.coalesce("common", F.lit(-1))).alias("common"),
            F.when(own, F.array().cast("array<bigint>")).when(F.col("pivot") == F.col("a"), F.col("only_a")).otherwise(F.col("only_b")).alias("lacks"),
            F.when(own, F.array().cast("array<bigint>")).when(F.col("pivot") == F.col("a"), F.col("only_b")).otherwise(F.col("only_a")).alias("beside"),
        )
        # a frequent list meets itself in cells of two salts
        other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("salts") - 1, F.lit(0))))
        cells = told.withColumn("o", other).withColumns({"i": F.least("salt", "o"), "j": F.greatest("salt", "o"), "block": F.col("salt")}).drop("o", "salt", "salts")
        found = shared_table(
            cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", F.desc("left"), "sid").mapInArrow(lambda b: _cell_answers(b, t), "a bigint, b bigint, proved boolean")
            .groupBy("a", "b").agg(F.bool_or("proved").alias("proved")),
            "join-derived",
        )
        forget(listed)
        rest = self._verify(found.filter("not proved").select("a", "b").join(known.select("a", "b"), ["a", "b"], "left_anti"))
        self.verified = self.verified if rest is None else self.verified.union(rest)
        return self.links().union(found.filter("proved").select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct()

    def members(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id, first of every row; ``first``: (doc_id, text_key) of the component's smallest."""
        none = self.spark.createDataFrame([], "sid bigint, component bigint")
        named = self.sets.join(none if self.member is None else self.member, "sid", "left").select("sid", "first", F.coalesce("component", "sid").alias("component"))
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        of_set = shared_table(named.join(least, "component").select("sid", "least"), "join-members")
        taking = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        return self.narrow.join(of_set, "sid", "left").select(
            "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(taking, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(taking, F.col("least")).alias("first")
        )


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text; a null has one of its own."""
    return F.xxhash64(text, text.isNull())


def near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return JaccardJoin(docs, Threshold(num, den), width).run().members().select("doc_id", "n_shingles", "component_id")


def all_links(docs: DataFrame, num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """doc_id, linked_id (doc_id < linked_id) of all links between different sets, each set named by its smallest document."""
    join = JaccardJoin(docs, Threshold(num, den), width)
    u, v = (join.sets.select(F.col("sid").alias(c), F.col("first.doc_id").alias(f"of_{c}")) for c in ("u", "v"))
    return join.answers().join(u, "u").join(v, "v").select(F.least("of_u", "of_v").alias("doc_id"), F.greatest("of_u", "of_v").alias("linked_id"))


def first_of_each(docs: DataFrame, num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, and of equal ids the smallest hash of its text.

    Rows are told apart by id and text, so of two texts with one id each is judged for itself. Rows without words
    stay; so do rows without an id; rows that repeat an id and a text count as one.
    """
    members = JaccardJoin(docs, Threshold(num, den), width).run().members()
    rest = members.filter(F.col("first").isNotNull() & (F.struct("doc_id", "text_key") != F.col("first"))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    kept = docs.join(rest, (docs["doc_id"].cast("bigint") == rest["_id"]) & (text_key(docs["text"].cast("string")) == rest["_key"]), "left_anti")
    repeated = docs.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1 and _id is not null").select("_id")
    if not repeated.head(1):
        return kept
    # of rows with one id, those with equal texts are one document
    again = kept["doc_id"] == repeated["_id"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
