"""Column functions: normalisers, extractors and predicates built on Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
URL = r"https?://[^\s\"'<>)]+"


def json_long(column: str, key: str) -> Column:
    """Whole number at ``key`` of a JSON string; null where it is absent or no number."""
    return F.get_json_object(F.col(column), f"$.{key}").try_cast("long")


def minute(ts: Column) -> Column:
    """Text of the minute that holds a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def tld(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([a-z]+)$", 1)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, from its own character counts."""
    letters = F.split(text, "")
    n = F.length(text)
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def path(text: Column) -> Column:
    """Forward slashes, single ones, lower case, no query or fragment, no slash at the end."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"[?#].*$", ""), r"[/\\]+", "/")
    return F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)


def ip_class(ip: Column) -> Column:
    """loopback, private, link_local, multicast, public, or invalid for an octet above 255."""
    part = lambda k: F.split(ip, r"\.")[k].cast("int")
    a, b = part(0), part(1)
    bad = F.greatest(*(part(k) for k in range(4))) > 255
    return (
        F.when(bad, "invalid").when(a == 127, "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 169) & (b == 254), "link_local").when(a.between(224, 239), "multicast").otherwise("public")
    )


def rot13(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper + lower, upper[13:] + upper[:13] + lower[13:] + lower[:13])


def first_of(cases: list[tuple[str, str]], default: str) -> Column:
    """Ordered first-match chain: name of the first condition (SQL) that holds."""
    chain = None
    for name, condition in cases:
        chain = (F if chain is None else chain).when(F.expr(condition), name)
    return chain.otherwise(default)


def names_of(cases: list[tuple[str, str]]) -> Column:
    """Comma-joined names of all conditions (SQL) that hold, in their order."""
    return F.concat_ws(",", *(F.when(F.expr(condition), name) for name, condition in cases))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns, each computed once however many expressions use it.

    Projections are merged by the optimizer, which would copy a long expression into every later use of it;
    a generator of one row is not merged.
    """
    others = [F.col(c) for c in df.columns if c not in columns]
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_computed")
    return df.select(*df.columns, row).select(*others, *(F.col(f"_computed.{n}").alias(n) for n in columns))
