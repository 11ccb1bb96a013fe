"""The operator's views: filters, flags, sorted pages, facets, keyset pages, merged tails, diffs of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The statuses of a host that is being read.
LIVE = ("connected", "throttled", "backpressure")
SORT_KEYS = {"throttled": "throttled_accounts", "source": "source", "events": "events_per_sec", "errors": "error_rate", "accounts": "accounts", "seq": "last_seq", "tier": "tier", "status": "status", "since": "since", "lag": "lag_ms"}


def flags() -> dict[str, Column]:
    at_cap = (F.col("max_accounts") > 0) & (F.col("accounts") >= F.col("max_accounts"))
    return {
        "atCap": at_cap, "lagging": F.col("status").isin(*LIVE) & (F.col("lag_ms") > 60_000), "erroring": F.col("error_rate") > 0.1, "throttledOrAtCap": (F.col("throttled_accounts") > 0) | at_cap,
    }


@dataclass
class HostQuery:
    """A host listing's filters, sort key and page. `source`: a name, `prefix*`, `prefix:` or `none`."""

    q: str | None = None
    tier: str | None = None
    status: str | None = None
    source: str | None = None
    throttled: bool | None = None
    rule: int | None = None
    flag: str | None = None
    sort: str | None = None
    desc: bool = False
    offset: int = 0
    limit: int = 10_000

    def condition(self) -> Column:
        if self.flag and self.flag not in flags():
            raise ValueError(f"no such flag: {self.flag}")
        out = F.lit(True)
        if self.q is not None:
            out &= F.col("host").contains(self.q)
        for name in ("tier", "status", "rule"):
            if (v := getattr(self, name)) is not None:
                out &= F.col(name) == v
        if self.source:
            have = F.coalesce("source", F.lit(""))
            if self.source.endswith("*"):
                out &= have.startswith(self.source[:-1])
            elif self.source.endswith(":"):
                out &= have.startswith(self.source)
            else:
                out &= have == ("" if self.source == "none" else self.source)
        if self.throttled is not None:
            out &= (F.col("throttled_accounts") > 0) == self.throttled
        return out & flags()[self.flag] if self.flag else out

    def run(self, rows: DataFrame) -> DataFrame:
        """The page, with `total`, the matches before paging. Ties keep the order by host, and descending turns both around."""
        kept = rows.filter(self.condition())
        key = SORT_KEYS.get(self.sort or "", "host")
        order = [F.col(key).asc_nulls_first(), F.col("host").asc()]
        if self.desc:
            order = [F.col(key).desc_nulls_last(), F.col("host").desc()]
        # One pass for the total and one for the page: a window over all rows would sort them in one task.
        page = kept.orderBy(*order).offset(self.offset).limit(self.limit)
        total = kept.agg(F.count("*").alias("total"))
        return page.join(F.broadcast(total))


def facets(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """For each faceted column the count of its values under all the other columns' filters."""
    out = None
    for name in filters:
        others = F.lit(True)
        for other, condition in filters.items():
            if other != name:
                others &= condition
        part = rows.filter(others).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
        out = part if out is None else out.union(part)
    return out


def keyset_page(rows: DataFrame, key: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next rows in order of the key, after a cursor."""
    if after is not None:
        rows = rows.filter(F.struct(*key) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(key, after, strict=True))))
    return rows.orderBy(*key).limit(limit)


def tail(kinds: list[DataFrame], since: int, limit: int, at: str = "at", tie: str = "id") -> DataFrame:
    """Rows of several logs after a time, newest first; the limit is held between 1 and 2000."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.filter(F.col(at) > since).orderBy(F.col(at).desc(), F.col(tie).desc()).limit(max(1, min(2000, limit)))


def sampled_tail(rows: DataFrame, second: str, order: str, most: int, held: int) -> DataFrame:
    """At most so many rows of a second, the newest `held` of all kept."""
    w = Window.partitionBy(second).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n").orderBy(F.col(order).desc()).limit(held)


def last_of_each(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The newest rows of each group, as evidence and trails are kept."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def handle_search(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """The exact handle, else those that begin with it; a star asks for the beginning at once."""
    wanted = text.rstrip("*").lower()
    begins = rows.filter(F.lower("handle").startswith(wanted))
    if text.endswith("*"):
        return begins.orderBy("handle").limit(limit)
    exact = rows.filter(F.lower("handle") == wanted)
    fall = begins.join(F.broadcast(exact.agg((F.count("*") == 0).alias("none"))).filter("none"))
    return exact.unionByName(fall.select(*rows.columns)).orderBy("handle").limit(limit)


def redacted(settings: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Values of settings with a secret's name become set or unset."""
    secret = F.lower(F.col(name)).rlike("secret|token|password|credential|_key$|^key$")
    return settings.withColumn(value, F.when(secret, F.when(F.coalesce(F.length(value), F.lit(0)) > 0, "set").otherwise("unset")).otherwise(F.col(value)))


def leaf_diff(before: DataFrame, after: DataFrame, key: list[str], most: int = 80) -> DataFrame:
    """Changes of documents given as rows (key, path, value): changed, added and removed leaves as lines of text."""
    b, a = before.withColumnRenamed("value", "b"), after.withColumnRenamed("value", "a")
    both = b.join(a, [*key, "path"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(F.col(c))
    line = F.when(F.col("b").isNull(), F.concat(F.col("path"), F.lit(": added "), cut("a"))).when(F.col("a").isNull(), F.concat(F.col("path"), F.lit(": removed "), cut("b"))).otherwise(F.concat(F.col("path"), F.lit(": "), cut("b"), F.lit(" -> "), cut("a")))
    return both.select(*key, "path", line.alias("line"))


def case_sessions(trips: DataFrame, closes: DataFrame, key: list[str], at: str = "at", tie: str = "id", kept: int = 20) -> DataFrame:
    """Incidents: a trip joins its key's open case or opens one; a close frees the key.

    trips: key, at, id, severity (rank), observed. closes: key, at, id. A case's number is the count of closes before it.
    """
    rows = trips.select(*key, at, tie, "severity", "observed", F.lit(0).alias("close")).union(closes.select(*key, at, tie, F.lit(None).cast("int"), F.lit(None).cast(trips.schema["observed"].dataType), F.lit(1)))
    w = Window.partitionBy(*key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("session", F.coalesce(F.sum("close").over(w), F.lit(0)))
    found = rows.groupBy(*key, "session").agg(
        F.min(F.when(F.col("close") == 0, F.col(at))).alias("opened"), F.max(F.when(F.col("close") == 0, F.col(at))).alias("updated"), F.max("severity").alias("severity"), F.count_if(F.col("close") == 0).alias("trips"),
        F.max_by("observed", F.when(F.col("close") == 0, F.struct(at, tie))).alias("observed"), F.max("close").alias("closed"),
    )
    return found.filter("trips > 0").withColumn("status", F.when(F.col("closed") == 1, "resolved").otherwise("open")).withColumn("evidence", F.least("trips", F.lit(kept))).drop("closed", "session")
