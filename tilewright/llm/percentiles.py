"""Exact percentiles per group over any number of values, by repeated bisection.

Each pass counts, in one aggregation, the rows of every open interval below `parts` - 1 cut
points and keeps, per target rank, the part that holds it, narrowed to the smallest and largest
value that really lie there. A target is resolved when both are equal. The cut points part signs
first, then magnitudes (in equal ratios), then values (in equal steps), so that no distribution
takes more than some ten passes. Only counts move between passes: groups x open intervals x
parts rows, whatever the number of values.

Days are kept as counts per value interval; those of several days add up, and the interval that
holds a target rank gives it within a relative error that does not depend on the number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import cut, folded, require, written

#: Stands for positive infinity in the arithmetic of the passes.
LARGEST = 1.7976931348623157e308


def rank_of(p: float | Column, n: Column) -> Column:
    """Rank (from 1) of the smallest value with at least the share p of n values at or below it."""
    p = F.lit(p) if isinstance(p, float) else p
    return F.greatest(F.lit(1), F.ceil(p * n - F.lit(1e-9))).cast("bigint")


def _part(v: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Which of the parts of the interval from lo to hi, lo < hi, v lies in; lo and hi never lie
    in the same one, and a larger v in no earlier one."""
    cut_at = lambda x: F.least(F.floor(x * parts), F.lit(parts - 1)).cast("int")
    return (
        F.when((lo <= 0) & (hi >= 0), F.when(v < 0, 0).when(v == 0, 1).otherwise(2))
        .when((lo > 0) & (hi / 4 > lo), cut_at((F.ln(v) - F.ln(lo)) / (F.ln(hi) - F.ln(lo))))
        .when((hi < 0) & (lo / 4 < hi), cut_at((F.ln(-lo) - F.ln(-v)) / (F.ln(-lo) - F.ln(-hi))))
        .otherwise(cut_at((v - lo) / (hi - lo)))
    )


def bisect(values: DataFrame, group: list[str], value: str, shares: list[float], parts: int = 512) -> DataFrame:
    """(group..., share, n, rank, value): for each group and share the exact percentile.

    values must not hold NaN or null in `value`, and is scanned once a pass, so it should be a
    written table; infinities are allowed. Null groups form a group. No values, no rows.
    """
    if parts < 2:
        raise ValueError("parts must be at least 2")
    v = F.least(F.greatest(F.col(value).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    rows = values.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], v.alias("v"))
    keys = [f"g{i}" for i in range(len(group))]
    start = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    goals = start.select(*keys, "n", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    goals = cut(goals.withColumn("rank", rank_of(F.col("share"), F.col("n"))))
    resolved = []
    while True:
        resolved.append(goals.where("lo = hi"))
        goals = goals.where("lo < hi")
        if goals.isEmpty():
            break
        other = [f"s{i}" for i in range(len(keys))]
        renamed = [F.col(k).alias(o) for k, o in zip([*keys, "lo", "hi", "below"], [*other, "slo", "shi", "sbelow"])]
        spans = goals.select(*renamed).distinct()
        same = " AND ".join(f"{k} <=> {o}" for k, o in zip(keys, other)) or "true"
        inside = rows.join(spans, F.expr(f"{same} AND v >= slo AND v <= shi"))
        part = _part(F.col("v"), F.col("slo"), F.col("shi"), parts)
        span = [*other, "slo", "shi", "sbelow"]
        counts = inside.groupBy(*span, part.alias("part")).agg(F.count("v").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("before", F.expr(f"sbelow + sum(k) OVER (PARTITION BY {', '.join(span)} ORDER BY part) - k"))
        found = goals.join(counts, F.expr(f"{same} AND lo = slo AND hi = shi AND rank > before AND rank <= before + k"))
        goals = cut(found.select(*keys, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("before").alias("below"), "share", "rank"))
    out = resolved[0]
    for r in resolved[1:]:
        out = out.unionByName(r)
    whole = F.when(F.col("lo") >= LARGEST, F.lit(float("inf"))).when(F.col("lo") <= -LARGEST, F.lit(float("-inf"))).otherwise(F.col("lo"))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], "share", "n", "rank", whole.alias(value))


def durations(attempts: DataFrame) -> DataFrame:
    """One row per attempt_id that counts: with a reader (folded) and a duration that is neither
    null, NaN nor negative; written once, since the passes scan it again and again."""
    require(attempts, "attempt_id", "reader_type", "duration_s", "run_day")
    rows = attempts.where("attempt_id IS NOT NULL AND reader_type IS NOT NULL AND duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s >= 0")
    rows = rows.select("attempt_id", folded("reader_type").alias("reader_type"), F.col("duration_s").cast("double").alias("duration_s"), "run_day")
    rows = rows.where("reader_type <> ''")
    one = rows.groupBy("attempt_id").agg(*[F.first(c).alias(c) for c in ("reader_type", "duration_s", "run_day")])
    return written(one, "durations")


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def reader_percentiles(attempts: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Exact percentiles of duration_s per reader.

    Repeated attempts count once. Attempts without reader, or whose duration is null, NaN or
    negative, don't count; zero and infinite durations do. Ties don't matter. A reader without
    counted attempts, or an empty table, gives no rows.
    """
    return bisect(durations(attempts), ["reader_type"], "duration_s", shares)


def outliers(attempts: DataFrame, share: float = 0.99, times: float = 5.0) -> DataFrame:
    """attempt_ids whose duration exceeds `times` the percentile of their reader; cases as in
    reader_percentiles()."""
    rows = durations(attempts)
    bounds = bisect(rows, ["reader_type"], "duration_s", [share]).select("reader_type", (F.col("duration_s") * times).alias("bound"))
    return rows.join(bounds, "reader_type").where("duration_s > bound").select("attempt_id")


#: Value intervals to each power of two: the relative error of combined days is at most 1 / STEPS.
STEPS = 1024


def _interval(value: str) -> Column:
    """The interval of a value that isn't negative: its exponent and first binary digits, which
    order as the values do."""
    bits = F.expr(f"CAST(reflect('java.lang.Double', 'doubleToLongBits', {value}) AS BIGINT)")
    return F.shiftright(bits, 52 - (STEPS - 1).bit_length())


SUMMARY = ["reader_type", "run_day", "interval"]


def day_summaries(attempts: DataFrame) -> DataFrame:
    """(reader_type, run_day, interval, n, least, most): per reader and day the value intervals
    that have rows, with their number, smallest and largest value. A day can be summarised on its
    own and kept. Attempts without run_day form the day null; cases as in reader_percentiles().
    """
    rows = durations(attempts).withColumn("interval", _interval("duration_s"))
    return rows.groupBy(*SUMMARY).agg(F.count("*").alias("n"), F.min("duration_s").alias("least"), F.max("duration_s").alias("most"))


def combine(summaries: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Percentiles per reader over all summarised days (reader_type, share, n, rank, least, most):
    least and most are the smallest and the largest value in the interval that holds the wanted
    rank. The exact percentile is one of the values between them, which differ by less than one
    part in STEPS. Summaries of parts of a day may be united before; none, no rows.
    """
    require(summaries, *SUMMARY, "n", "least", "most")
    counts = summaries.groupBy("reader_type", "interval").agg(F.sum("n").alias("k"), F.min("least").alias("least"), F.max("most").alias("most"))
    run = "OVER (PARTITION BY reader_type ORDER BY interval)"
    counts = counts.select("*", F.expr(f"sum(k) {run}").alias("upto"), F.expr("sum(k) OVER (PARTITION BY reader_type)").alias("n"))
    goals = counts.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    goals = goals.withColumn("rank", rank_of(F.col("share"), F.col("n")))
    return goals.where("rank <= upto AND rank > upto - k").select("reader_type", "share", "n", "rank", "least", "most")
