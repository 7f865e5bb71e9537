"""Row-wise functions on scalar and list columns: cleaning, padding, clipping, remapping, time features.

Sequences are newest first. Everything here is a built-in expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.edges import GAP_EDGES, count_less

UTC_OFFSET = 8 * 3600
SUMMARY_WINDOWS = (3600, 86400, 604800, 2592000)
SUMMARY_SPAN = math.log1p(730 * 86400)


def clean_int(value: Column) -> Column:
    """Null and values of zero or less become 0."""
    return F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0).cast("long"))


def clean_list(values: Column) -> Column:
    return F.transform(values, clean_int)


def newest(values: Column, cap: int) -> Column:
    return F.slice(F.coalesce(values, F.array()), 1, cap)


def pad_ints(values: Column, width: int) -> Column:
    """First `width` entries, cleaned, filled up with 0."""
    kept = clean_list(F.slice(F.coalesce(values, F.array().cast("array<long>")), 1, width))
    return F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(kept)))


def pad_floats(values: Column, width: int) -> Column:
    kept = F.slice(F.coalesce(values.cast("array<float>"), F.array().cast("array<float>")), 1, width)
    return F.concat(kept, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(kept)))


def shared_length(columns: list[Column], cap: int) -> Column:
    """Length of a domain: the longest side-information list, at most cap; zeros count."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in columns]
    return F.least(F.greatest(*sizes) if len(sizes) > 1 else sizes[0], F.lit(cap))


def clip_vocab(value: Column, vocab: int) -> Column:
    """Values of vocab or more become 0; a feature without vocabulary is 0 throughout."""
    return F.lit(0).cast("long") if vocab <= 0 else F.when(value >= vocab, F.lit(0).cast("long")).otherwise(value)


def remap(value: Column, rank: Column, k: int, keep_default: bool = True) -> Column:
    """0 stays 0, a known id becomes its rank, any other K+1; without keep_default the later clip turns K+1 into 0."""
    other = F.lit(k + 1 if keep_default else 0).cast("long")
    return F.when(value <= 0, F.lit(0).cast("long")).otherwise(F.coalesce(rank.cast("long"), other))


def recency_id(row_ts: Column, ts: Column, edges: list[int]) -> Column:
    """0 for ts = 0, else 1 + the number of edges below the age; ages beyond the last edge share its bucket."""
    age = F.greatest(row_ts - ts, F.lit(0).cast("long"))
    return F.when(ts == 0, F.lit(0)).otherwise(F.least(count_less(age, edges), F.lit(len(edges) - 1)) + 1)


def gap_id(ts: Column, older: Column) -> Column:
    """0 unless both times are positive; else 1 + the number of gap edges below the difference, 32 at most."""
    gap = F.greatest(ts - older, F.lit(0).cast("long"))
    return F.when((ts > 0) & (F.coalesce(older, F.lit(0)) > 0), F.least(count_less(gap, GAP_EDGES), F.lit(len(GAP_EDGES))) + 1).otherwise(F.lit(0))


def recency_ids(row_ts: Column, ts: Column, edges: list[int], cap: int) -> Column:
    """Recency ids of a newest-first list, padded to cap."""
    return F.transform(raw_padded(ts, cap), lambda t: recency_id(row_ts, t, edges))


def raw_padded(ts: Column, cap: int) -> Column:
    """First cap entries as they are (negatives too), nulls and the rest 0."""
    kept = F.transform(F.slice(F.coalesce(ts, F.array().cast("array<long>")), 1, cap), lambda t: F.coalesce(t.cast("long"), F.lit(0).cast("long")))
    return F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.lit(cap) - F.size(kept)))


def gap_ids(ts: Column, cap: int) -> Column:
    """Gap ids between neighbours of the padded list; the last of the cap slots is 0."""
    padded = raw_padded(ts, cap)
    return F.zip_with(padded, F.concat(F.slice(padded, 2, cap), F.array(F.lit(0).cast("long"))), gap_id)


def hour_id(ts: Column) -> Column:
    return (F.floor(F.pmod(ts + UTC_OFFSET, F.lit(86400)) / 3600) + 1).cast("int")


def weekday_id(ts: Column) -> Column:
    """Monday is 1."""
    return (F.pmod(F.floor((ts + UTC_OFFSET) / 86400) + 3, F.lit(7)) + 1).cast("int")


def month_id(ts: Column) -> Column:
    return F.month(F.timestamp_seconds(ts + UTC_OFFSET)).cast("int")


def calendar_id(ts: Column, part) -> Column:
    """One of the three above for a sequence token: 0 for ts = 0."""
    return F.when(ts == 0, F.lit(0)).otherwise(part(ts))


def time_summary(row_ts: Column, ts: Column, cap: int) -> list[Column]:
    """Eight numbers of a newest-first list: newest and oldest age, span, density, counts within four windows."""
    padded = raw_padded(ts, cap)
    n = F.size(F.filter(padded, lambda t: t > 0))
    age = lambda t: F.greatest(row_ts - t, F.lit(0).cast("long"))
    newest_, oldest = F.element_at(padded, 1), F.try_element_at(padded, F.greatest(n, F.lit(1)))
    span = F.greatest(newest_ - oldest, F.lit(0).cast("long"))
    scale = math.log1p(cap)
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    out = [some(F.log1p(age(newest_).cast("double")) / SUMMARY_SPAN), some(F.log1p(age(oldest).cast("double")) / SUMMARY_SPAN), some(F.log1p(span.cast("double")) / SUMMARY_SPAN)]
    out.append(some(F.log1p(n / F.log1p(span / 86400.0 + 1)) / scale))
    within = lambda w: F.size(F.filter(padded, lambda t: (t > 0) & (age(t) <= w)))
    return out + [some(F.log1p(within(w).cast("double")) / scale) for w in SUMMARY_WINDOWS]


SUMMARY_NAMES = ("age_newest", "age_oldest", "span", "density", "within_1h", "within_1d", "within_7d", "within_30d")


def gather(values: Column, valid: Column, k: int, side: str = "head") -> Column:
    """k valid tokens from the newest (head) or the oldest (tail) end, filled up with 0; order is kept."""
    if side not in ("head", "tail"):
        raise ValueError("side is head or tail")
    start = F.lit(1) if side == "head" else F.greatest(valid - k, F.lit(0)) + 1
    kept = F.slice(values, start, F.least(valid, F.lit(k)))
    return F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(kept)))


def gather_mask(valid: Column, k: int) -> Column:
    """True at the slots of gather() that hold a token."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i < F.least(valid, F.lit(k)))


def padding_mask(length: Column, width: int) -> Column:
    """True where a position lies at or beyond the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= length)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def one_decimal(x: Column) -> Column:
    """A value of zero or more with one digit after the point, rounded by its exact binary value; exact halves go to the even digit.

    20 x is compared with the odd number between two tenths without error: x is split in two halves whose products are exact.
    """
    k = F.floor(x * 10)
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    over = (high * 20 - (k * 2 + 1)) + (x - high) * 20
    tenths = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def readable_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s < 120, F.concat(F.rint(s).cast("long").cast("string"), F.lit("s")))
        .when(s < 7200, F.concat(one_decimal(s / 60), F.lit("m")))
        .when(s < 172800, F.concat(one_decimal(s / 3600), F.lit("h")))
        .otherwise(F.concat(one_decimal(s / 86400), F.lit("d")))
    )


def round_edge(seconds: Column) -> Column:
    """Nearest readable edge: steps of 5 s, 30 s, 5 min, 1 h or 1 day by magnitude; halves go to the even multiple."""
    s = seconds.cast("double")
    to = lambda step: (F.bround(s / step, 0) * step).cast("long")
    return F.when(s < 60, F.greatest(F.lit(1).cast("long"), to(5))).when(s < 3600, to(30)).when(s < 86400, to(300)).when(s < 30 * 86400, to(3600)).otherwise(to(86400))


def strictly_increasing(values: list[int]) -> list[int]:
    """A short list of edges with ties and drops lifted by one step of the previous edge's magnitude."""
    out: list[int] = []
    for v in map(int, values):
        if out and v <= out[-1]:
            step = next(s for below, s in ((60, 5), (3600, 30), (86400, 300), (30 * 86400, 3600), (math.inf, 86400)) if out[-1] < below)
            v = out[-1] + step
        out.append(v)
    return out
