"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the longest length are cut into pieces of it and a rest. Pieces are taken from the
longest to the shortest. A piece goes to the open bin that it fills best (the least space left). If
no bin can take it, a bin is opened at the length with the least cost for each token that it will
hold, as far as the lengths still to come tell: its content is this piece and, greedily, the longest
pieces left that fit. At the end every bin is downsized to the shortest permitted length that holds
its content.

The cost of a sequence of length c is c * (1 + c / ``attention``) + ``overhead``.

Pieces are dealt to shards by a hash of their row, about ``SHARD_PIECES`` each; shards are packed
independently, each in bounded memory. A text of millions of pieces is dealt to all shards, too.

Defined results: a text without tokens, or null, is one piece of length 0 in no bin (null bin and
capacity 0); repeated rows and ids are packed each; an empty table gives no rows; the result does
not depend on the order of rows but for rows that are equal in id and length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

LENGTHS = (256, 512, 1024, 2048, 4096)
SHARD_PIECES = 40_000


def pack(lengths: np.ndarray, permitted: tuple[int, ...], attention: float = 65536.0, overhead: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, final length of that bin) of each piece; lengths from 1 to the longest permitted, longest first."""
    permitted = tuple(sorted(permitted))
    cost = {c: c * (1 + c / attention) + overhead for c in permitted}
    top = permitted[-1]
    remaining = np.bincount(lengths, minlength=top + 1).tolist()
    present = sum(1 << n for n in set(lengths.tolist()))  # lengths still to come, as bits
    spaces: list[list[int]] = [[] for _ in range(top + 1)]
    free = 0  # bits: a bin with just so much space is open
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []

    def filled(length: int, size: int) -> int:
        """Tokens that a bin opened for a piece will hold, greedily."""
        left, total, taken = size - length, length, {length: 1}
        while left > 0:
            low = present & ((1 << (left + 1)) - 1)
            if not low:
                break
            n = low.bit_length() - 1
            if n == 0:
                break
            count = min(left // n, remaining[n] - taken.get(n, 0))
            if count <= 0:
                rest = low & ~(1 << n)
                while rest:  # shorter ones
                    n = rest.bit_length() - 1
                    count = min(left // n, remaining[n] - taken.get(n, 0)) if n else 0
                    if count > 0:
                        break
                    rest &= ~(1 << n)
                if not rest:
                    break
            taken[n] = taken.get(n, 0) + count
            total, left = total + n * count, left - n * count
        return total

    for k, length in enumerate(lengths.tolist()):
        fits = free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                free &= ~(1 << space)
        else:
            space = min((c for c in permitted if c >= length), key=lambda c: (cost[c] / filled(length, c), -c))
            b = len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += length
        left = space - length
        if left:
            spaces[left].append(b)
            free |= 1 << left
        remaining[length] -= 1
        if not remaining[length]:
            present &= ~(1 << length)
    final = np.array([next(c for c in permitted if c >= u) for u in used], np.int64)
    return bins, offsets, final[bins] if len(bins) else np.zeros(0, np.int64)


def _packed(rows: pd.DataFrame, permitted: tuple[int, ...], attention: float, overhead: float) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
    bins, offsets, capacity = pack(rows["length"].to_numpy(np.int64), permitted, attention, overhead)
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
            "bin_id": (rows["shard"].to_numpy(np.int64) << 32) + bins, "bin_offset": offsets, "bin_capacity": capacity,
        }
    )


_RESULT = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint, bin_capacity bigint"


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, attention: float = 65536.0, overhead: float = 8.0, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Where each piece of each (doc_id, n_tokens) row goes: bin, offset in it, and the bin's final length."""
    top = max(lengths)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"))
    rows = shared_table(narrow.withColumn("row", F.monotonically_increasing_id()), "packing")
    count = int(rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / top)))).first()[0] or 0)
    shards = max(1, -(-count // shard_pieces))
    pieces = (
        rows.filter(F.col("n_tokens") > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tokens - 1) div {top}"))))
        .withColumn("start", F.col("piece") * top)
        .withColumn("length", F.least(F.lit(top).cast("bigint"), F.col("n_tokens") - F.col("start")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).cast("int"))
        .select("doc_id", "row", "piece", "start", "length", "shard")
    )
    packed = pieces.groupBy("shard").applyInPandas(lambda x: _packed(x, lengths, attention, overhead), _RESULT)
    none = rows.filter(F.col("n_tokens") <= 0).selectExpr("doc_id", "0L AS piece", "0L AS start", "0L AS length", "CAST(NULL AS BIGINT) AS bin_id", "0L AS bin_offset", "0L AS bin_capacity")
    return packed.union(none)
