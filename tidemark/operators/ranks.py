"""Ranks, running sums and exact quantiles without a task that sees a whole domain.

Values are laid into equal-width blocks between the smallest and the largest of their group. Block totals are few (BLOCKS a
group), so their prefix sums are cheap; what lies inside a block is ordered by the task that gets the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 4096


def block_of(value: Column, low: Column, high: Column, blocks: int = BLOCKS) -> Column:
    """Number of the block of a value, rising with it."""
    wide = high.cast("double") - low.cast("double")
    at = F.floor((value.cast("double") - low.cast("double")) / wide * blocks).cast("long")
    return F.when(wide > 0, F.least(at, F.lit(blocks - 1).cast("long"))).otherwise(F.lit(0).cast("long"))


def before(what: str, keys: list[str], order: list) -> Column:
    """Sum of what comes before a row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(w), F.lit(0))


def ranked(counts: DataFrame, most: int | None = None) -> DataFrame:
    """counts (domain, token, n, pos, head) with rank by count, ties by id, and running sums. most: ranks beyond it are not worked out.

    Distinct counts of a domain are few (their sum is at most its tokens, so under the root of twice that), and are ranked
    as such; ids of equal count are ranked block by block.
    """
    sums = [F.count("*").alias("ids"), *(F.sum(c).alias(f"s_{c}") for c in ("n", "pos", "head"))]
    parts = ("ids", "s_n", "s_pos", "s_head")
    by_count = counts.groupBy("domain", "n").agg(*sums)
    by_count = by_count.select("domain", "n", *(before(c, ["domain"], [F.col("n").desc()]).alias(f"c_{c}") for c in parts))
    if most is not None:
        by_count = by_count.where(F.col("c_ids") < most)
    span = counts.groupBy("domain").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    laid = counts.join(F.broadcast(span), "domain").withColumn("block", block_of(F.col("token"), F.col("low"), F.col("high"))).drop("low", "high")  # a row a domain
    blocks = laid.groupBy("domain", "n", "block").agg(*sums)
    blocks = blocks.select("domain", "n", "block", *(before(c, ["domain", "n"], ["block"]).alias(f"b_{c}") for c in parts))
    start = blocks.join(by_count, ["domain", "n"]).select("domain", "n", "block", *((F.col(f"b_{c}") + F.col(f"c_{c}")).alias(f"at_{c}") for c in parts))
    inside = Window.partitionBy("domain", "n", "block").orderBy("token")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.join(start, ["domain", "n", "block"])
    sums = [(F.col(f"at_s_{c}") + F.sum(c).over(run)).alias(f"run_{c}") for c in ("n", "pos", "head")]
    return placed.select(*counts.columns, (F.col("at_ids") + F.row_number().over(inside)).cast("long").alias("rank"), *sums)


def quantiles(values: DataFrame, by: list[str], wanted: list[float], column: str = "value", nearest: bool = False) -> DataFrame:
    """by..., slot, v: exact quantiles of a column, a row a group and quantile; linear between neighbours, or the nearest rank.

    Only values of blocks that hold a wanted rank are ordered. Null and NaN values are left out.
    """
    keys = by or ["__all"]
    c = F.col(column)
    some = values.where(c.isNotNull() & ~F.isnan(c.cast("double"))).select(*(by or [F.lit(0).alias("__all")]), c.alias("__v"))
    span = some.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("*").alias("__n"))
    laid = some.join(F.broadcast(span), keys).withColumn("__block", block_of(F.col("__v"), F.col("__low"), F.col("__high")))  # a row a group
    blocks = laid.groupBy(*keys, "__block").agg(F.count("*").alias("__size"), F.first("__n").alias("__n"))
    blocks = blocks.withColumn("__from", before("__size", keys, ["__block"]))
    at = (lambda q: F.greatest(F.ceil(F.col("__n") * F.lit(q)) - 1, F.lit(0)).cast("double")) if nearest else (lambda q: (F.col("__n") - 1) * F.lit(float(q)))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), at(q).alias("at")) for k, q in enumerate(wanted)]))
    hit = lambda first, size: (F.floor("a.at") < first + size) & (F.ceil("a.at") >= first)
    chosen = blocks.select("*", asked.alias("a")).where(hit(F.col("__from"), F.col("__size"))).select(*keys, "__block", "__from", "a")
    few = laid.join(F.broadcast(chosen.select(*keys, "__block", "__from").distinct()), [*keys, "__block"])  # two rows a group and quantile at most
    steps = few.groupBy(*keys, "__block", "__v").agg(F.count("*").alias("__size"), F.first("__from").alias("__from"))
    steps = steps.withColumn("__from", F.col("__from") + before("__size", [*keys, "__block"], ["__v"]))
    met = steps.join(F.broadcast(chosen.select(*keys, "__block", "a")), [*keys, "__block"]).where(hit(F.col("__from"), F.col("__size")))
    holds = lambda rank: (rank >= F.col("__from")) & (rank < F.col("__from") + F.col("__size"))
    low = F.max(F.when(holds(F.floor("a.at")), F.col("__v").cast("double")))
    high = F.max(F.when(holds(F.ceil("a.at")), F.col("__v").cast("double")))
    share = F.max("a.at") - F.floor(F.max("a.at"))
    return met.groupBy(*keys, F.col("a.slot").alias("slot")).agg((low * (1 - share) + high * share).alias("v")).select(*by, "slot", "v")


def as_columns(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Quantiles as a column each, one row a group."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("slot") == k, F.col("v"))).alias(n) for k, n in enumerate(names)])
