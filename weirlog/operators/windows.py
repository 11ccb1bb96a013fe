"""Windowed counts, sliding estimates, threshold crossings, rolling rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(seconds: Column, width: Column | int) -> Column:
    """Start of the tumbling window, counted from 1970."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.floor(seconds / width) * width


def sliding(events: DataFrame, keys: list[str], at: str = "s", order: str = "event_id", weight: str | None = None) -> DataFrame:
    """Adds `cur` (running sum in the tumbling window), `prev` (sum of the window just before) and `numerator`.

    `width` must be a column of the rows. The sliding count is numerator / width, kept whole:
    cur x width + prev x (width - seconds into the window). The previous window comes by a join on
    (keys, window), so nothing but one window of one key is ever sorted together.
    """
    n = F.col(weight) if weight else F.lit(1)
    rows = events.withColumn("win", tumbling(F.col(at), F.col("width")))
    keyed = [*keys, "width"]
    totals = rows.groupBy(*keyed, "win").agg(F.sum(n).alias("prev"))
    before = totals.withColumn("win", F.col("win") + F.col("width"))
    running = Window.partitionBy(*keyed, "win").orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("cur", F.sum(n).over(running)).join(before, [*keyed, "win"], "left").withColumn("prev", F.coalesce("prev", F.lit(0)))
    return counted.withColumn("numerator", F.col("cur") * F.col("width") + F.col("prev") * (F.col("width") - (F.col(at) - F.col("win"))))


def first_crossings(counted: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """The first row of each key and window whose sliding count reaches `limit`; a limit of 0 or less is off."""
    over = counted.filter((F.col("limit") > 0) & (F.col("numerator") >= F.col("limit") * F.col("width")))
    first = F.min(F.struct(order, "s", "numerator")).alias("first")
    return over.groupBy(*keys, "width", "limit", "win").agg(first).select(*keys, "win", "limit", f"first.{order}", "first.s", "first.numerator")


def standing(events: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Each key's sliding numerator at one time, from its current and previous windows."""
    rows = events.withColumn("win", tumbling(F.col("s"), F.col("width"))).withColumn("now_win", tumbling(as_of, F.col("width")))
    recent = rows.filter(F.col("win") >= F.col("now_win") - F.col("width"))
    share = F.when(F.col("win") == F.col("now_win"), F.col("width")).otherwise(F.col("width") - (as_of - F.col("now_win")))
    return recent.groupBy(*keys, "width").agg(F.sum(share).alias("numerator"))


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)


def seconds_of(rows: DataFrame, keys: list[str], at: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row a second and key between its first and last, empty seconds included with zeros."""
    sums = rows.groupBy(*keys, at).agg(*(c.alias(k) for k, c in aggregates.items()))
    span = sums.groupBy(*keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    every = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(at))
    return every.join(sums, [*keys, at], "left").fillna(0, list(aggregates))


def rolling_sum(rows: DataFrame, keys: list[str], at: str, column: str, last: int, name: str) -> DataFrame:
    """Sum over a row and those before it, `last` in all."""
    return rows.withColumn(name, F.sum(column).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - last, 0)))


def rates(rows: DataFrame, keys: list[str], at: str, counters: list[str]) -> DataFrame:
    """Counter deltas (never negative) and the time since the sample before; a key's first sample only primes."""
    w = Window.partitionBy(*keys).orderBy(at)
    out = rows.withColumn("dt", F.col(at) - F.lag(at).over(w))
    for c in counters:
        out = out.withColumn(f"d_{c}", F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)))
    return out.filter("dt is not null")


def decayed_rate(samples: DataFrame, keys: list[str], at: str, dt: str, rate: str, tau: float) -> DataFrame:
    """Exponentially weighted rate at each key's last sample, by the weight gathered (so it isn't biased early on).

    A sample weighs (1 - exp(-dt / tau)) x exp(-(T - t) / tau); both sums run in one aggregation.
    """
    last = samples.groupBy(*keys).agg(F.max(at).alias("__end"))
    w = (1 - F.exp(-F.col(dt) / tau)) * F.exp(-(F.col("__end") - F.col(at)) / tau)
    both = samples.join(last, keys).groupBy(*keys).agg(F.sum(w * F.col(rate)).alias("a"), F.sum(w).alias("b"))
    return both.select(*keys, (F.col("a") / F.col("b")).alias("rate"))


def quantile_rows(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact discrete quantiles."""
    return rows.groupBy(*keys).agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast(rows.schema[value].dataType).alias(k) for k, q in quantiles.items()))


def indexed_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The element at round((n - 1) x q) of the sorted values; half rounds up."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    at = lambda q: F.floor((F.col("__n") - 1) * q + 0.5)
    return numbered.groupBy(*keys).agg(F.max("__n").alias("n"), *(F.max(F.when(F.col("__i") == at(q), F.col(value))).alias(k) for k, q in quantiles.items()))


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile of a histogram of (le, n), interpolated inside its bucket: rank = q x total; the lower edge is the bucket before."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumn("upto", F.sum("n").over(w)).withColumn("lower", F.coalesce(F.lag("le").over(w), F.lit(0)))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("want", F.col("total") * q)
    hit = rows.filter((F.col("upto") >= F.col("want")) & (F.col("n") > 0))
    first = hit.groupBy(*keys).agg(F.min(F.struct("le", "lower", "n", "upto", "want", "total")).alias("b")).select(*keys, "b.*")
    inside = (F.col("want") - (F.col("upto") - F.col("n"))) / F.col("n")
    return first.select(*keys, "total", (F.col("lower") + (F.col("le") - F.col("lower")) * inside).alias("value"))
