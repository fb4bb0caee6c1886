"""Mixing sources to target weights, with DataFrame operations only.

A tree of domains, languages and sources has a weight at every node. A token budget goes down the
tree: a node's children share its budget by weight, no child gets more than what its leaves can
supply over ``max_epochs`` epochs, and what a short child leaves is shared among its siblings, again
by weight, before anything is left to the level above. As a node's own budget is bounded by what its
children can supply together, a shortage reaches an ancestor's siblings only when all siblings are
full. The shares are found in closed form: children are sorted by supply over weight, and a child is
short if and only if its supply over its weight is at most the rest of the budget over the rest of the
weights when its turn comes.

Each leaf then takes the prefix of its stream, which is one seeded permutation of its documents after
another (an epoch each), up to its budget in tokens: all documents in each full epoch, and of the last
epoch the documents that begin before the budget ends. A leaf can hold a third of all rows, so
prefixes are found in two steps: tokens by leaf and hash range (``RANGES``), added up in order, and
then within the one range of each leaf where the budget ends.

Defined results: null domain, language or source is a node of its own, apart from one named '', and has the
default weight; documents with no tokens,
or a null text, take no tokens and are chosen with those that begin where they do; documents without
an id are ordered as id ''; of repeated rows each counts (``kept_rows`` judges rows that are equal in leaf, id
and length alike); a weight that is missing is ``default_weight``,
negative ones count as 0; a node without weight gets nothing unless its siblings leave
something that they cannot take; shares are whole tokens, so a node may leave fewer tokens than it has children; an
empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, shared_table

LEVELS = ("domain", "lang", "source")
RANGES = 4096
"""Hash ranges of a leaf: the first three hex digits of an md5."""
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """A stand-in domain where a table has none: sources dealt to four domains by a digit of their md5."""
    digit = F.substring(F.md5(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), 1, 1)
    return F.concat(F.lit("domain"), F.translate(digit, "0123456789abcdef", "0000111122223333"))


def _share(nodes: DataFrame, parent: list[str], own: str, budget: str) -> DataFrame:
    """``share``, a whole number of tokens, of each child of the ``parent`` nodes.

    ``nodes`` has the parents' names, the child's name ``own``, its weight, its capacity, and the
    parents' budget. Weighted children come first, by capacity over weight; what they leave
    goes to those without weight in order of their names.
    """
    weightless = F.when(F.col("weight") > 0, 0).otherwise(1)
    order = Window.partitionBy(*parent).orderBy(weightless, F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")), own)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    ranked = (
        nodes.withColumn("_left", left)
        .withColumn("_rest", F.sum("weight").over(after))
        .withColumn("_short", F.when(F.col("weight") > 0, F.col("capacity").cast("double") * F.col("_rest") <= F.greatest(F.col("_left"), F.lit(0)).cast("double") * F.col("weight")).otherwise(False))
    )
    # the first child that is not short sets the level for all after it
    level = Window.partitionBy(*parent)
    open_ = F.when(~F.col("_short") & (F.col("weight") > 0), F.struct(F.col("capacity") / F.col("weight"), F.col(own), F.col("_left"), F.col("_rest")))
    shared = ranked.withColumn("_level", F.min(open_).over(level)).withColumn(
        "share",
        F.when(F.col("_short"), F.col("capacity"))
        .when(F.col("weight") > 0, F.least(F.col("capacity"), F.floor(F.col("_level._left").cast("double") * F.col("weight") / F.col("_level._rest")).cast("bigint")))
        .otherwise(F.when(F.col("_level").isNull(), F.greatest(F.lit(0), F.least(F.col("capacity"), F.col("_left")))).otherwise(F.lit(0)))
        .cast("bigint"),
    )
    return shared.drop("_left", "_rest", "_short", "_level")


def leaf_budgets(leaves: DataFrame, weights: DataFrame | None, budget: int, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """domain, lang, source, supply, share of each leaf of (domain, lang, source, supply) rows.

    ``weights``: (domain, lang, source, weight) rows; lang and source null for a domain's weight,
    source null for a language's within its domain.
    """
    named = leaves.select(*(_node(F.col(c)).alias(c) for c in LEVELS), "supply")
    if weights is not None:
        weights = weights.select(*(F.when(F.col(c).isNotNull(), _node(F.col(c))).alias(c) for c in LEVELS), "weight")
    found = _leaf_shares(named, weights, budget, max_epochs, default_weight)
    return found.withColumns({c: F.when(F.col(c) != "", F.expr(f"substring({c}, 2)")) for c in LEVELS})


def _node(name: Column) -> Column:
    """A node's key: a null's is empty, any other name's begins with '='."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _leaf_shares(leaves: DataFrame, weights: DataFrame | None, budget: int, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """``leaf_budgets`` by nodes' keys."""
    now = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    parents: list[str] = []
    shares: DataFrame | None = None
    for depth, own in enumerate(LEVELS):
        path = [*parents, own]
        nodes = now.groupBy(*path).agg(F.sum("capacity").cast("bigint").alias("capacity"))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(float(default_weight)))
        else:
            given = weights.filter(F.col(own).isNotNull())
            if depth + 1 < len(LEVELS):
                given = given.filter(F.col(LEVELS[depth + 1]).isNull())
            given = given.groupBy(*path).agg(F.max(F.col("weight").cast("double")).alias("weight"))
            nodes = nodes.join(given, path, "left").withColumn("weight", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(float(default_weight)))))
        if shares is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("bigint")).withColumn("root", F.lit(0))
            shared = _share(nodes, ["root"], own, "budget").drop("root")
        else:
            shared = _share(nodes.join(shares, parents), parents, own, "budget")
        shares = shared.select(*path, F.col("share").alias("budget"))
        parents = path
    return now.join(shares, list(LEVELS)).select(*LEVELS, "supply", F.col("budget").alias("share"))


def _ends(rows: DataFrame, weights: DataFrame | None, budget: int | float, max_epochs: int, seed: int, keys: list[str]) -> DataFrame:
    """Of each leaf: full epochs, tokens of the epoch taken in part, the range where they end and the tokens before it."""
    leaves = rows.groupBy(*keys).agg(F.sum("n_tokens").cast("bigint").alias("supply")).select(*(F.col(k).alias(k[1:]) for k in keys), "supply")
    leaves = shared_table(leaves, "mix-leaves")
    if isinstance(budget, float):
        budget = int(budget * (leaves.agg(F.sum("supply")).first()[0] or 0))
    if weights is not None:
        weights = weights.select(*(F.when(F.col(c).isNotNull(), _node(F.col(c))).alias(c) for c in LEVELS), "weight")
    shares = _leaf_shares(leaves, weights, budget, max_epochs).select(
        *(F.col(k[1:]).alias(k) for k in keys),
        F.when(F.col("supply") > 0, F.expr("share div supply")).otherwise(0).cast("int").alias("_full"),
        F.when(F.col("supply") > 0, F.col("share") % F.col("supply")).otherwise(0).cast("bigint").alias("_part"),
    )
    shares = shared_table(shares, "mix-shares")
    placed = _placed(rows, shares, keys, seed)
    # tokens before each range of each leaf: RANGES rows a leaf at most
    sums = placed.groupBy(*keys, "_range").agg(F.sum("n_tokens").cast("bigint").alias("_tokens"), F.first("_part").alias("_part"))
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("_before", F.coalesce(F.sum("_tokens").over(by_range), F.lit(0)))
        .filter(F.col("_before") < F.col("_part"))
        .groupBy(*keys)
        .agg(F.max(F.struct("_range", "_before")).alias("_last"))
        .select(*keys, F.col("_last._range").alias("_cut"), F.col("_last._before").alias("_before"))
    )
    ends = shared_table(shares.join(last, keys, "left"), "mix-ends")
    forget(leaves, shares)
    return ends


def _at_end(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the range in which a leaf's tokens end that begin before that, with ``_start``."""
    within = Window.partitionBy(*keys).orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.filter(F.col("_range") == F.col("_cut"))
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .filter(F.col("_start") < F.col("_part"))
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None, budget: int | float, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch, taken_tokens: a row for each epoch that takes a document.

    ``docs`` has doc_id, domain, lang, source and n_tokens. ``budget``: tokens, or a share (a float)
    of all there are.
    """
    keys = [f"_{c}" for c in LEVELS]
    named = [_node(F.col(c)).alias(k) for c, k in zip(LEVELS, keys, strict=True)]
    rows = shared_table(docs.select("doc_id", *LEVELS, F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"), *named), "mix-rows")
    placed = _placed(rows, _ends(rows, weights, budget, max_epochs, seed, keys), keys, seed)
    out = ["doc_id", *LEVELS, "n_tokens"]
    full = placed.filter(F.col("_full") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full") - 1))).withColumn("taken_tokens", F.col("n_tokens"))
    before = placed.filter(F.col("_range") < F.col("_cut")).withColumns({"epoch": F.col("_full"), "taken_tokens": F.col("n_tokens")})
    at_end = _at_end(placed, keys).withColumns({"epoch": F.col("_full"), "taken_tokens": F.least(F.col("n_tokens"), F.col("_part") - F.col("_start"))})
    parts = [x.select(*out, F.col("epoch").cast("int").alias("epoch"), F.col("taken_tokens").cast("bigint").alias("taken_tokens")) for x in (full, before, at_end)]
    return parts[0].union(parts[1]).union(parts[2])


def kept_rows(docs: DataFrame, domain: Column, n_tokens: Column, weights: DataFrame | None, budget: int | float, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, that one epoch of the mixture takes.

    ``docs`` has doc_id, lang and source. No row is found again by its id: a leaf's end is a place in its order, and every
    row is compared with it, so rows without an id, or that share one, are judged like any other.
    """
    keys = [f"_{c}" for c in LEVELS]
    narrow = docs.select("doc_id", F.coalesce(n_tokens.cast("bigint"), F.lit(0)).alias("n_tokens"), *(_node(c).alias(k) for c, k in zip((domain, F.col("lang"), F.col("source")), keys, strict=True)))
    rows = shared_table(narrow, "mix-rows")
    ends = _ends(rows, weights, budget, 1, seed, keys)
    place = F.struct("_order", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n_tokens")
    last = _at_end(_placed(rows, ends, keys, seed), keys).groupBy(*keys).agg(F.max(place).alias("_last"))
    ends = shared_table(ends.join(last, keys, "left").select(*keys, "_full", "_cut", "_last"), "mix-cuts")
    forget(rows)
    # the row's own columns travel as one, so that no name of theirs meets one of these
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", F.coalesce(n_tokens.cast("bigint"), F.lit(0)).alias("n_tokens"), *(_node(c).alias(k) for c, k in zip((domain, F.col("lang"), F.col("source")), keys, strict=True)))
    placed = _placed(named, ends, keys, seed)
    taken = (F.col("_full") > 0) | (F.col("_range") < F.col("_cut")) | ((F.col("_range") == F.col("_cut")) & (place <= F.col("_last")))
    return placed.filter(taken).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))


def _placed(rows: DataFrame, leaves: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows with their leaf's columns, their place in the epoch that is taken in part, and its range."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.join(leaves, keys).withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
