"""Host names, patterns and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top-level names that no public host can have.
RESERVED = ("local", "localhost", "internal", "arpa", "invalid", "test", "example", "onion", "lan", "home", "corp", "intranet")

_LABEL = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"
_V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
_V6 = r"^(?=.*:.*:)[0-9a-f:]+(\d+\.\d+\.\d+\.\d+)?$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def labels_ok(name: Column) -> Column:
    """Every label of 1 to 63 letters, digits and inner hyphens, at most 253 in all."""
    return (F.length(name) <= 253) & F.forall(F.split(name, r"\."), lambda x: x.rlike(_LABEL))


def numeric_tld(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1).rlike("^[0-9]+$")


def normalized(raw: Column) -> Column:
    """struct(host, error) of what a caller typed; outside development mode, so without IP addresses and ports."""
    s = F.regexp_replace(F.regexp_replace(F.lower(trimmed(raw)), "^(https://|wss://|http://|ws://)", ""), "/$", "")
    has_port = s.contains(":")
    port = F.regexp_extract(s, ":([^:]*)$", 1)
    good_port = port.rlike(r"^\+?[0-9]{1,9}$") & (port.cast("long") <= 65_535)
    name = F.regexp_replace(F.when(has_port, F.regexp_replace(s, ":[^:]*$", "")).otherwise(s), r"\.$", "")
    many = F.size(F.split(name, r"\.")) >= 2
    error = (
        F.when(s == "", "empty")
        .when(F.length(s) > 260, "too_long")
        .when(s.rlike(r"[/?#@\\%\s\x00-\x1f\x7f]"), "not_bare")
        .when(s.startswith("["), F.when(~s.contains("]"), "not_bare").when(F.regexp_extract(s, r"^\[([^\]]*)\]", 1).rlike(_V6), "ip").otherwise("label"))
        .when(s.rlike(_V6) | s.rlike(_V4), "ip")
        .when(has_port & ~good_port, "port")
        .when(name == "", "empty")
        .when(F.length(name) > 253, "too_long")
        .when(has_port & (port.cast("long") != 443), "port")
        .when(name.rlike(_V4), "ip")
        .when(~labels_ok(name), "label")
        .when(F.element_at(F.split(name, r"\."), -1).isin(*RESERVED), "reserved")
        .when(~many, "few_labels")
        .when(numeric_tld(name), "label")
    )
    return F.struct(F.when(error.isNull(), name).alias("host"), error.alias("error"))


def admissible(raw: Column) -> Column:
    """struct(host, insecure, error) for an admission request: scheme optional, path ignored, a port only on localhost."""
    s = trimmed(raw)
    scheme = F.when(s.contains("://"), F.lower(F.substring_index(s, "://", 1)))
    rest = F.when(s.contains("://"), F.regexp_replace(s, r"^[\s\S]*?://", "")).otherwise(s)
    authority = F.lower(F.element_at(F.split(rest, r"[/?#]"), 1))
    port = F.when(authority.contains(":"), F.regexp_extract(authority, ":([^:]*)$", 1))
    name = F.regexp_replace(F.when(port.isNull(), authority).otherwise(F.regexp_replace(authority, ":[^:]*$", "")), r"\.+$", "")
    valid = labels_ok(name) & (F.size(F.split(name, r"\.")) >= 2) & ~numeric_tld(name)
    error = (
        F.when(scheme.isNotNull() & ~scheme.isin("https", "wss", "http", "ws"), "scheme")
        .when(port.isNotNull() & ~port.rlike("^[0-9]+$"), "syntax")
        .when(name == "localhost", F.lit(None))
        .when(port.isNotNull(), "port")
        .when(~valid, "syntax")
    )
    host = F.when((name == "localhost") & port.isNotNull(), F.concat(name, F.lit(":"), port)).otherwise(name)
    return F.struct(F.when(error.isNull(), host).alias("host"), F.coalesce(scheme.isin("http", "ws"), F.lit(False)).alias("insecure"), error.alias("error"))


def pattern(raw: Column) -> Column:
    """struct(pattern, error): an exact name, an IPv4 address, localhost with or without a port, or *.domain."""
    p = F.lower(F.regexp_replace(trimmed(raw), r"\.+$", ""))
    base = F.regexp_replace(p, r"^\*\.", "")
    port = F.when(p.contains(":"), F.regexp_extract(p, ":([^:]*)$", 1))
    name = F.regexp_replace(p, ":[^:]*$", "")
    valid = lambda n: labels_ok(n) & (F.size(F.split(n, r"\.")) >= 2) & ~numeric_tld(n)
    good_port = port.isNull() | (port.rlike("^[0-9]{1,5}$") & port.cast("long").between(1, 65_535))
    ok = F.when(p.startswith("*."), valid(base)).otherwise(good_port & (valid(name) | (name == "localhost") | name.rlike(_V4)))
    return F.struct(F.when(ok, p).alias("pattern"), F.when(~ok, "pattern").alias("error"))


def url_host(url: Column) -> Column:
    """Host of a URL, with a port that isn't the scheme's own."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    own = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(host != "", F.when((port == "") | own, host).otherwise(F.concat(host, F.lit(":"), port)))


def suffixes(host: Column) -> Column:
    """The name and every parent of at least two labels, longest first, of a host without its port."""
    parts = F.split(F.element_at(F.split(host, ":"), 1), r"\.")
    n = F.size(parts)
    # The name itself may be a single label; parents need two.
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), "."))


def matches(pat: Column, host: Column) -> Column:
    """Whether a pattern covers a host: equal, or for *.base the base or a name below it."""
    base = F.regexp_replace(pat, r"^\*\.", "")
    return F.when(pat.startswith("*."), (host == base) | F.endswith(host, F.concat(F.lit("."), base))).otherwise(host == pat)
