"""Order-preserving selection: first of each, top of each, capped, in priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of_each(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return top_of_each(df, keys, 1, *order)


def top_of_each(df: DataFrame, keys: Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each key; ranks are cut off before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Keys in the order of their first positions: one aggregation, no sort of the rows."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def one_per_group_first(df: DataFrame, group: str, n: int, *rank: str | Column) -> DataFrame:
    """n rows: the first of each group before any second one, by rank within each."""
    # no group gives more than its first n rows, so ranks are cut off before the shuffle
    w = Window.partitionBy(group).orderBy(*rank)
    numbered = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return numbered.orderBy((F.col("_rank") > 1).cast("int"), *rank).limit(n).drop("_rank")


def round_robin(pending: DataFrame, rotation: DataFrame, cursor: int, *order: str | Column) -> DataFrame:
    """Pending items in fair turns: each source's next item, sources from the cursor on, then again.

    ``rotation``: (source_name, pos). Adds ``turn`` (from 0), the order in which sources are served.
    """
    n = rotation.count()
    start = cursor % n if n else 0
    item = Window.partitionBy("source_name").orderBy(*order)
    return pending.join(rotation, "source_name").withColumn("round", F.row_number().over(item) - 1).withColumn("place", F.pmod(F.col("pos") - start, F.lit(max(n, 1))))


def greedy_capped(df: DataFrame, group: Sequence[str], order: Sequence[str], caps: dict[str, int | dict[str, int]], limit: int) -> DataFrame:
    """Rows of each group in order, as long as no cap of theirs is used up; a rejected row uses none.

    Caps on several columns are coupled, so ranks of windows can't express them. A group is one
    article's facts: hundreds of rows.
    """
    schema = df.schema

    def pick(rows):
        used: dict[tuple[str, object], int] = {}
        kept = []
        for at, row in rows.sort_values(list(order), kind="stable").iterrows():
            slots = [(c, row[c]) for c in caps]
            bounds = [caps[c].get(v, 0) if isinstance(caps[c], dict) else caps[c] for c, v in slots]
            if len(kept) < limit and all(used.get(s, 0) < b for s, b in zip(slots, bounds, strict=True)):
                kept.append(at)
                for s in slots:
                    used[s] = used.get(s, 0) + 1
        return rows.loc[kept]

    return df.groupBy(*group).applyInPandas(pick, schema)
