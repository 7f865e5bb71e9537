"""Vocabulary tail analysis: token statistics, heavy hitters, coverage, thresholds, maps. One exact pass.

Input: one row a token with domain, pos, token, label_type, and a key of the sample. Counts are grouped once by
(domain, token); everything ranked is computed on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.edges import position_bucket
from tidemark.functions.sequences import ratio
from tidemark.operators.ranks import ranked


def positive() -> Column:
    """Null labels are not positive."""
    return F.coalesce(F.col("label_type"), F.lit(0)) == 2


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def sample_lengths(tokens: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """domain, label_type, raw_len, nonzero_len, n: how many samples have a sequence of these lengths.

    Samples without tokens of a domain have length 0; they are counted as all samples less those that have some, so no
    row is made for them. Every sample of tokens must be in rows.
    """
    per = tokens.groupBy(key, "domain").agg(F.max("label_type").alias("label_type"), F.count("*").alias("raw_len"), count_if(F.col("token") > 0).alias("nonzero_len"))
    present = per.groupBy("domain", "label_type", "raw_len", "nonzero_len").agg(F.count("*").alias("n"))
    every = rows.groupBy("label_type").agg(F.count("*").alias("__all"))
    grid = present.select("domain").distinct().crossJoin(F.broadcast(every))  # a row a domain and label
    have = present.groupBy(F.col("domain").alias("__d"), F.col("label_type").alias("__l")).agg(F.sum("n").alias("__have"))
    absent = grid.join(have, (F.col("domain") == F.col("__d")) & F.col("label_type").eqNullSafe(F.col("__l")), "left")
    zero = F.lit(0).cast("long")
    absent = absent.select("domain", "label_type", zero.alias("raw_len"), zero.alias("nonzero_len"), (F.col("__all") - F.coalesce("__have", zero)).alias("n"))
    return present.unionByName(absent.where("n > 0"))


def token_statistics(tokens: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    per = sample_lengths(tokens, rows, key)
    of = lambda what, c=F.lit(True): F.sum(F.when(c, what).otherwise(0)).cast("long")
    n, some = F.col("n"), F.col("nonzero_len") > 0
    return per.groupBy("domain").agg(
        of(n).alias("n_rows"), of(n, positive()).alias("pos_rows"), of(n, some).alias("rows_present"), of(n, some & positive()).alias("pos_rows_present"),
        of(F.col("raw_len") * n).alias("total_tokens"), of(F.col("nonzero_len") * n).alias("nonzero_tokens"), of(F.col("nonzero_len") * n, positive()).alias("nonzero_pos_tokens"),
    )


def length_quantiles(per: DataFrame) -> DataFrame:
    """Nearest-rank quantiles of raw and nonzero lengths, from length histograms (zeros count)."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_len").alias("len")) for k in ("raw", "nonzero")])).alias("l")
    steps = per.select("domain", "n", both).groupBy("domain", "l.kind", "l.len").agg(F.sum("n").alias("n"))
    side = Window.partitionBy("domain", "kind")  # a row a length
    upto = F.sum("n").over(side.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.select("domain", "kind", "len", upto.alias("upto"), F.sum("n").over(side).alias("total"))
    cut = lambda k, p: F.min(F.when((F.col("kind") == k) & (F.col("upto") >= F.ceil(F.col("total") * F.lit(p))), F.col("len")))
    return placed.groupBy("domain").agg(*[cut(k, p).alias(f"{k}_p{int(p * 100)}") for k in ("raw", "nonzero") for p in (0.5, 0.9, 0.99)])


def length_histogram(per: DataFrame, length: str = "raw_len") -> DataFrame:
    return per.groupBy("domain", length).agg(F.sum("n").alias("n"))


def position_totals(tokens: DataFrame) -> DataFrame:
    return tokens.where("token > 0").groupBy("domain", position_bucket(F.col("pos")).alias("bucket")).agg(F.count("*").alias("n"), count_if(positive()).alias("pos"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """domain, token, n, pos, head (tokens at positions under 50)."""
    return tokens.where("token > 0").groupBy("domain", "token").agg(F.count("*").alias("n"), count_if(positive()).alias("pos"), count_if(F.col("pos") < 50).alias("head"))


def domain_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("domain").agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"), F.count("*").alias("ids"))


def heavy_hitters(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent ids of each domain with coverage and positive rate."""
    top = ranked(counts, k).where(F.col("rank") <= k).join(F.broadcast(domain_totals(counts)), "domain")
    return top.select("domain", "rank", "token", "n", ratio(F.col("n"), F.col("total")).alias("coverage"), ratio(F.col("pos"), F.col("n")).alias("pos_rate"))


def topk_coverage(counts: DataFrame, ks: list[int]) -> DataFrame:
    """A row a domain and K; a K beyond the number of ids takes all of them."""
    wanted = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    rows = ranked(counts, max(ks)).select("*", wanted).where(F.col("rank") <= F.col("k"))
    quantile = lambda p: F.floor(F.round(F.expr(f"percentile(n, {p})"), 6)).cast("long")
    low = lambda t: ratio(count_if(F.col("n") < t), F.count("*")).alias(f"share_lt{t}")
    got = rows.groupBy("domain", "k").agg(F.sum("n").alias("count"), F.sum("pos").alias("pos"), F.sum("head").alias("head"), F.min("n").alias("cutoff_count"), quantile(0.1).alias("count_p10"), quantile(0.5).alias("count_p50"), low(10), low(50), low(100))
    got = got.join(F.broadcast(domain_totals(counts)), "domain")
    return got.select("domain", "k", "count", ratio(F.col("count"), F.col("total")).alias("coverage"), ratio(F.col("pos"), F.col("count")).alias("pos_rate"), ratio(F.col("head"), F.col("total")).alias("head_coverage"), "cutoff_count", "count_p10", "count_p50", "share_lt10", "share_lt50", "share_lt100")


def count_thresholds(counts: DataFrame, thresholds: list[int]) -> DataFrame:
    """A row a domain and minimum count: how many ids reach it and what they cover; rows for thresholds nobody reaches too."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("min_count")
    hit = F.col("n") >= F.col("min_count")
    got = counts.select("*", t).groupBy("domain", "min_count").agg(count_if(hit).alias("k"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("count"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("pos"), F.sum(F.when(hit, F.col("head")).otherwise(0)).alias("head"), F.sum("n").alias("total"), F.min(F.when(hit, F.col("n"))).alias("cutoff_count"))
    cover = ratio(F.col("count"), F.col("total"))
    return got.select("domain", "min_count", "k", "count", cover.alias("coverage"), (1 - cover).alias("default_share"), ratio(F.col("pos"), F.col("count")).alias("pos_rate"), ratio(F.col("head"), F.col("total")).alias("pos0_50_coverage"), F.coalesce("cutoff_count", F.lit(0)).cast("long").alias("cutoff_count"), F.when(F.col("k") > 0, F.col("k") + 2).otherwise(0).cast("long").alias("embedding_rows"))


def recommended_k(coverage: DataFrame, ks: list[int]) -> DataFrame:
    """domain, k: the first K that covers 90 %, else 70 %, else the last."""
    first = lambda c: F.min(F.when(F.col("coverage") >= c, F.col("k")))
    return coverage.groupBy("domain").agg(F.coalesce(first(0.9), first(0.7), F.lit(ks[-1])).alias("k"))


def rescue_scores(counts: DataFrame, ks: list[int], capacity: int | None = None) -> DataFrame:
    """Head/tail split at the candidate capacity, lift of the recommended head over the tail, and the score that ranks domains."""
    cover = topk_coverage(counts, ks)
    best = recommended_k(cover, ks).join(cover, ["domain", "k"])
    r = ranked(counts)
    outside = F.lit(False) if capacity is None else F.col("rank") > capacity
    tail = r.groupBy("domain").agg(F.sum("n").alias("total"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("tail_count"), F.sum(F.when(outside, F.col("pos")).otherwise(0)).alias("tail_pos"))
    lift = ratio(F.col("pos_rate"), ratio(F.col("tail_pos"), F.col("tail_count")))
    score = F.col("coverage") * (1 + F.least(F.lit(1.0), F.col("head_coverage") * 2)) * (0.25 + F.abs(lift - 1)) * F.log1p(F.col("total").cast("double"))
    return best.join(tail, "domain").select("domain", "k", "coverage", "tail_count", lift.alias("head_tail_lift"), score.alias("rescue_score"))


def position_split(tokens: DataFrame, map_: DataFrame) -> DataFrame:
    """domain, bucket, in_head, n, pos: tokens of each position bucket whose id is in the map or not."""
    known = map_.select("domain", "token", F.lit(True).alias("__known"))
    marked = tokens.where("token > 0").join(known, ["domain", "token"], "left").withColumn("in_head", F.col("__known").isNotNull())
    return marked.groupBy("domain", position_bucket(F.col("pos")).alias("bucket"), "in_head").agg(F.count("*").alias("n"), count_if(positive()).alias("pos"))


def topk_map(counts: DataFrame, k: int) -> DataFrame:
    """domain, token, rank of the first k ids: the map that remap() reads."""
    return ranked(counts, k).where(F.col("rank") <= k).select("domain", "token", "rank")


def min_count_map(counts: DataFrame, least: int) -> DataFrame:
    return ranked(counts.where(F.col("n") >= least)).select("domain", "token", "rank")


def recut(map_: DataFrame, k: int) -> DataFrame:
    """First k ids of a map; an error if a domain has fewer."""
    short = map_.groupBy("domain").agg(F.max("rank").alias("have")).where(F.col("have") < k)
    if not short.isEmpty():
        raise ValueError(f"a map holds fewer than {k} ids")
    return map_.where(F.col("rank") <= k)


#: Maps up to this many rows are broadcast in a remap; larger ones are joined by their own plan.
BROADCAST_ROWS = 1_000_000


def remap_tokens(tokens: DataFrame, map_: DataFrame, k: int, keep_default: bool = True) -> DataFrame:
    """tokens with `mapped`. The map holds at most k ids a domain, which decides whether it is broadcast."""
    from tidemark.functions.sequences import remap

    side = F.broadcast(map_) if k <= BROADCAST_ROWS else map_
    return tokens.join(side, ["domain", "token"], "left").withColumn("mapped", remap(F.col("token"), F.col("rank"), k, keep_default)).drop("rank")


def out_of_bounds(tokens: DataFrame, vocab: int) -> DataFrame:
    """domain, n, lowest, highest of the values that a vocabulary clips."""
    return tokens.where(F.col("token") >= vocab).groupBy("domain").agg(F.count("*").alias("n"), F.min("token").alias("lowest"), F.max("token").alias("highest"))


def check_bounds(tokens: DataFrame, vocab: int, strict: bool = False) -> DataFrame:
    """out_of_bounds(); with strict, an error if there is any such value."""
    found = out_of_bounds(tokens, vocab)
    if strict and (worst := found.orderBy(F.col("n").desc()).first()):
        raise ValueError(f"{worst.domain}: {worst.n} values from {worst.lowest} to {worst.highest} reach the vocabulary of {vocab}")
    return found


def gini(counts: DataFrame) -> DataFrame:
    """Gini coefficient of the counts of each domain. Grouped by count first, so ranks are over distinct counts."""
    by = counts.groupBy("domain", "n").agg(F.count("*").alias("ids"))
    below = Window.partitionBy("domain").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = by.withColumn("before", F.coalesce(F.sum("ids").over(below), F.lit(0)))
    # the ranks of a run of equal counts sum to ids * before + ids * (ids + 1) / 2
    ranks = F.col("ids") * F.col("before") + F.col("ids") * (F.col("ids") + 1) / 2
    s = placed.groupBy("domain").agg(F.sum(ranks * F.col("n")).alias("weighted"), F.sum(F.col("ids") * F.col("n")).alias("total"), F.sum("ids").alias("m"))
    return s.select("domain", (2 * F.col("weighted") / (F.col("m") * F.col("total")) - (F.col("m") + 1) / F.col("m")).alias("gini"))


def unseen_rate(train: DataFrame, valid: DataFrame) -> DataFrame:
    """domain, tokens, unseen: validation tokens whose id training never shows, with their denominators."""
    known = train.where("token > 0").select("domain", "token").distinct().withColumn("seen", F.lit(1))
    got = valid.where("token > 0").groupBy("domain", "token").agg(F.count("*").alias("n")).join(known, ["domain", "token"], "left")
    return got.groupBy("domain").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("seen").isNull(), F.col("n")).otherwise(0)).alias("unseen")).withColumn("rate", ratio(F.col("unseen"), F.col("tokens")))
