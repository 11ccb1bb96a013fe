"""Rate limits and budgets with closed forms, event clocks, backoff, cost grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debt_bucket(takes: DataFrame, key: list[str], at: str, n: str, order: str, rate: float, burst: float) -> DataFrame:
    """Tokens after each take of a bucket that may go into debt, and the wait until it is out of it (seconds).

    x = min(burst, x + rate x dt) - n has a closed form: with A the running sum of (rate x dt - n), the balance is
    A + min(burst, least of (burst - n - A) so far). An endless rate never waits, nor does one of 0 or less.
    """
    w = Window.partitionBy(*key).orderBy(at, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = takes.withColumn("__a", F.coalesce((F.col(at) - F.lag(at).over(w)) * F.lit(rate), F.lit(0.0)) - F.col(n)).withColumn("__A", F.sum("__a").over(upto))
    rows = rows.withColumn("tokens", F.col("__A") + F.least(F.lit(float(burst)), F.min(F.lit(float(burst)) - F.col(n) - F.col("__A")).over(upto)))
    wait = F.when((F.col("tokens") >= 0) | F.lit(rate <= 0), 0.0).otherwise(-F.col("tokens") / rate) if rate != float("inf") else F.lit(0.0)
    return rows.withColumn("wait", wait).drop("__a", "__A")


def daily_budget(asks: DataFrame, at: str, order: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """Admissions until the day's limit."""
    w = Window.partitionBy(*(by or []), F.floor(F.col(at) / 86_400)).orderBy(at, order)
    return asks.withColumn("admitted", F.row_number().over(w) <= limit)


def request_guard(samples: DataFrame, at: str, a: str, window: int, burst: int, rate: float, most: int, total: int) -> DataFrame:
    """The first sample at which cumulative requests breach a total, a rate over a window, or a burst, and which."""
    w = Window.orderBy(at)
    back = lambda s: Window.orderBy(at).rangeBetween(Window.unboundedPreceding, -s)
    t0, a0 = F.last(at).over(back(window)), F.last(a).over(back(window))
    near = F.first(a).over(Window.orderBy(at).rangeBetween(-burst, 0))
    rows = samples.withColumn("r_dt", F.col(at) - t0).withColumn("r_da", F.col(a) - a0).withColumn("b_da", F.when(F.row_number().over(w) == 1, F.col(a)).otherwise(F.col(a) - near))
    why = F.when(F.col(a) >= total, "total").when(F.col("r_da") > F.col("r_dt") * rate, "rate").when(F.col("b_da") > most, "burst")
    return rows.withColumn("why", why).filter("why is not null").orderBy(at).limit(1).select(at, a, "why")


def event_clock(events: DataFrame, key: list[str], order: str, event: str, now: str, horizon: int) -> DataFrame:
    """A host's clock: never back, never ahead of now, never further behind it than the horizon."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("clock", F.greatest(F.max(F.least(F.greatest(F.col(event), F.col(now) - horizon), F.col(now))).over(w), F.col(now) - horizon))


def read_lag(now: Column, newest_read: Column, read_at: Column, held: Column, idle_ms: int = 10_000) -> Column:
    """Age of the newest frame when it was read, plus the time it was held; nothing after ten idle seconds."""
    return F.when(now - read_at >= idle_ms, 0).otherwise(F.greatest(read_at - newest_read, F.lit(0)) + held)


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Half of the doubled delay; the other half is chance and left out."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)) / 2


def bursts_due(t: Column, period: int, length: int, rate: int) -> Column:
    """Accounts due by t when each period begins with a burst."""
    return F.floor(t / period) * length * rate + F.least(t % period, F.lit(length)) * rate


def tiered_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each amount at each provider: every tier bills what lies between its bounds; the cheapest is marked.

    usage: scenario, amount. prices: provider, lo, hi (null: open), price. Prices are few, so each amount meets each tier.
    """
    met = usage.join(F.broadcast(prices))
    billed = F.greatest(F.least("amount", F.coalesce("hi", "amount")) - F.col("lo"), F.lit(0)) * F.col("price")
    costs = met.groupBy("scenario", "provider").agg(F.sum(billed).alias("cost"))
    best = costs.groupBy("scenario").agg(F.min(F.struct("cost", "provider"))["provider"].alias("best"))
    return costs.join(best, "scenario").select("scenario", "provider", "cost", (F.col("provider") == F.col("best")).alias("cheapest"))


def version_after(a: Column, b: Column) -> Column:
    """1, 0 or -1 by the numbers of two versions `n` or `boot:n`; null if they don't compare."""
    node = lambda v: F.when(v.contains(":"), F.regexp_replace(v, ":[^:]*$", "")).otherwise("")
    number = lambda v: F.element_at(F.split(v, ":"), -1).try_cast("decimal(38,0)")
    return F.when((node(a) == node(b)) & number(a).isNotNull() & number(b).isNotNull(), F.sign(number(a) - number(b)).cast("int"))


def cidr_contains(cidr: Column, ip: Column) -> Column:
    """Whether an IPv4 address lies in a block."""
    whole = lambda c: F.aggregate(F.split(c, r"\."), F.lit(0).cast("long"), lambda x, p: x * 256 + p.cast("long"))
    bits = F.element_at(F.split(cidr, "/"), 2).cast("int")
    base = F.element_at(F.split(cidr, "/"), 1)
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return F.floor(whole(base) / size) == F.floor(whole(ip) / size)


def client_ip(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The first address from the right that no trusted proxy has; only believed when the peer itself is trusted."""
    known = lambda ip: F.exists(F.array(*(F.lit(t) for t in trusted)), lambda t: cidr_contains(t, ip))
    hops = F.reverse(F.split(F.regexp_replace(F.coalesce(forwarded, F.lit("")), r"\s", ""), ","))
    outside = F.filter(F.filter(hops, lambda h: h.rlike(r"^\d+(\.\d+){3}$")), lambda h: ~known(h))
    return F.when(known(peer) & (F.size(outside) > 0), F.try_element_at(outside, F.lit(1))).otherwise(peer)


def consumer_position(rows: DataFrame) -> DataFrame:
    """Position and lag, in events, of each consumer; slow ones are live and more than a quarter of the cutoff behind.

    rows: id, last (null: nothing sent), start (null: live), head, cutoff, backfilling.
    """
    position = F.coalesce("last", F.when(F.col("backfilling"), F.col("start")), F.col("head"))
    out = rows.withColumn("position", position).withColumn("lag", F.greatest(F.col("head") - F.col("position"), F.lit(0)))
    return out.withColumn("slow", ~F.col("backfilling") & (F.col("lag") * 4 > F.col("cutoff")))


def window_progress(rows: DataFrame, now: Column) -> DataFrame:
    """How far each export window has come: parts a thousand between its start (one past the window before) and its end.

    rows: n, after, until (null: open), done.
    """
    begin = F.coalesce(F.lag("until").over(Window.orderBy("n")) + 1, F.lit(0))
    out = rows.withColumn("begin", begin).withColumn("end", F.coalesce("until", now))
    return out.withColumn("permille", F.when(F.col("done"), 1000).otherwise(F.floor(F.least(F.greatest((F.col("after") - F.col("begin")) * 1000 / F.greatest(F.col("end") - F.col("begin"), F.lit(1)), F.lit(0)), F.lit(1000)))))
