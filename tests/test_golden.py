"""Golden values of the row features, computed by hand from the constants."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.functions import metrics as M
from tidemark.functions import sequences as S


def ids(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v long")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("preset", "pairs"),
    [
        ("original", {0: 1, 5: 1, 6: 2, 60: 12, 61: 13, 3600: 31, 86400: 47, 86401: 48, 604800: 53, 2592000: 57, 31536000: 63, 31536001: 63}),
        ("hybrid_v1", {0: 1, 60: 1, 61: 2, 86400: 6, 86401: 7, 604800: 11, 2592000: 21, 21513600: 63, 99999999: 63}),
    ],
)
def test_recency(spark, preset, pairs):
    row_ts = 200_000_000
    assert ids(spark, pairs, lambda d: S.recency_id(F.lit(row_ts).cast("long"), F.lit(row_ts) - d, E.preset(preset))) == list(pairs.values())


def test_unknown_preset():
    with pytest.raises(ValueError, match="hybrid_v1"):
        E.preset("none")


def test_edge_counts():
    assert [len(e) for e in (E.RECENCY_ORIGINAL, E.RECENCY_HYBRID_V1, E.GAP_EDGES)] == [63, 63, 31]
    for e in (E.RECENCY_ORIGINAL, E.RECENCY_HYBRID_V1, E.GAP_EDGES):
        assert e == sorted(set(e))


def test_gap(spark):
    pairs = {0: 1, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 1024: 11, 1025: 12, 1073741824: 31, 1073741825: 32}
    assert ids(spark, pairs, lambda g: S.gap_id(F.lit(2_000_000_000).cast("long"), F.lit(2_000_000_000) - g)) == list(pairs.values())


def test_calendar(spark):
    rows = {1773841188: (22, 3, 3), 1774222835: (8, 1, 3), 0: (9, 4, 1), 1709164800: (9, 4, 2), 1704038399: (24, 7, 12), 1704067199: (8, 1, 1)}
    for k, f in enumerate((S.hour_id, S.weekday_id, S.month_id)):
        assert ids(spark, rows, f) == [v[k] for v in rows.values()]
        assert ids(spark, [0], lambda t, f=f: S.calendar_id(t, f)) == [0]


def test_worked_sequence(spark):
    df = spark.createDataFrame([(1_000_000, [999990, 999400, 990000, 0, -1])], "t long, ts array<long>")
    t, ts = F.col("t"), F.col("ts")
    r = df.select(S.recency_ids(t, ts, E.RECENCY_ORIGINAL, 6).alias("r"), S.gap_ids(ts, 6).alias("g"), *[c.alias(n) for c, n in zip(S.time_summary(t, ts, 6), S.SUMMARY_NAMES, strict=True)]).first()
    assert list(r.r) == [2, 21, 35, 0, 54, 0]
    assert list(r.g) == [11, 15, 0, 0, 0, 0]
    want = [0.133515, 0.512837, 0.512781, 0.827444, 0.564575, 0.712414, 0.712414, 0.712414]
    assert [r[n] for n in S.SUMMARY_NAMES] == pytest.approx(want, abs=1e-5)


def test_remap_and_clip(spark):
    ranks = {50: 1, 7: 2, 99: 3}
    df = spark.createDataFrame([(k, v, ranks.get(v)) for k, v in enumerate([0, 7, 50, 99, 123])], "k int, v long, rank int")
    m = S.remap(F.col("v"), F.col("rank"), 3)
    rows = df.select("k", m.alias("m"), S.clip_vocab(m, 4).alias("c"), S.remap(F.col("v"), F.col("rank"), 3, keep_default=False).alias("d")).orderBy("k").collect()
    assert [r.m for r in rows] == [0, 2, 1, 3, 4]
    assert [r.c for r in rows] == [r.d for r in rows] == [0, 2, 1, 3, 0]


def test_padding(spark):
    df = spark.createDataFrame([([5, -1, None, 7],), (None,), ([],)], "v array<long>")
    assert [list(r.x) for r in df.select(S.pad_ints(F.col("v"), 3).alias("x")).collect()] == [[5, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert [list(r.x) for r in df.select(S.pad_ints(F.col("v"), 6).alias("x")).collect()][0] == [5, 0, 0, 7, 0, 0]
    assert S.strictly_increasing([5, 5, 3, 60, 60, 4000, 4000, 90000, 90000]) == [5, 10, 15, 60, 90, 4000, 4300, 90000, 93600]


def test_round_edge(spark):
    pairs = {2: 1, 7: 5, 8: 10, 75: 60, 105: 120, 3750: 3600, 90000: 90000, 2635200: 2592000}
    assert ids(spark, pairs, S.round_edge) == list(pairs.values())


def test_auc_edges(spark):
    one = spark.createDataFrame([(0.2, 1.0), (0.4, 1.0)], "p double, y double")
    assert M.auc_and_log_loss(one, "p", "y").first().auc == 0.0
    none = M.auc_and_log_loss(one.where("p > 1"), "p", "y").first()
    assert none.n == 0 and none.log_loss == float("inf")
    tied = spark.createDataFrame([(0.5, 1.0), (0.5, 0.0), (float("nan"), 1.0), (0.9, 1.0)], "p double, y double")
    assert M.auc_and_log_loss(tied, "p", "y").first().auc == pytest.approx(0.75)
