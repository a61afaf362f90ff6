"""Indicators in free texts, and JSON that is nested, fenced or cut off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalise as N
from . import vocabulary as V

URL = r"(?:https?|ftp)://[^\s'\"<>)\]}]+"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV6 = r"(?i)(?<![0-9a-f:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}|::(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})(?![0-9a-f:.])"
QUAD = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DOMAIN = r"(?i)(?<![a-z0-9@._-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?![a-z0-9._-]*[a-z0-9_@-])"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _kind(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def is_domain(name: Column) -> Column:
    """A name whose last label is no file ending and no private top domain, and that is no number."""
    low = F.lower(name)
    return F.contains(low, F.lit(".")) & ~F.regexp_extract(low, r"([^.]*)$", 1).isin(V.NON_TLD) & ~low.rlike("^[0-9.]+$")


def indicators(text: Column) -> Column:
    """Distinct (kind, value) of URLs, their hosts and ports, addresses of both versions, names, host:port pairs and mail addresses.

    What lies within a URL or a mail address is not told again by itself; quads with a number above 255 or a leading zero are none.
    """
    text = F.coalesce(text, F.lit(""))
    urls = F.transform(_all(text, URL), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
    rest = F.regexp_replace(text, URL, " ")
    mails = _all(rest, MAIL)
    rest = F.regexp_replace(rest, MAIL, " ")
    hosts = F.transform(urls, lambda u: F.lower(F.regexp_extract(u, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)))
    ports = F.transform(urls, lambda u: F.regexp_extract(u, r"^[a-z]+://(?:[^/@]*@)?[^/:?#]+:([0-9]{1,5})", 1))
    pairs = F.regexp_extract_all(rest, F.lit(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:([0-9]{1,5})\b"), 1)
    good_port = lambda p: (p != "") & p.try_cast("int").between(1, 65535)
    quads = F.filter(F.concat(_all(rest, QUAD), F.filter(hosts, lambda h: h.rlike(N.QUAD))), N.is_quad)
    names = F.filter(F.concat(F.transform(_all(rest, DOMAIN), F.lower), F.filter(hosts, lambda h: ~h.rlike(N.QUAD))), is_domain)
    parts = (_kind("url", urls), _kind("ipv4", quads), _kind("ipv6", F.transform(_all(rest, IPV6), F.lower)), _kind("domain", names), _kind("port", F.filter(F.concat(ports, pairs), good_port)), _kind("mail", F.transform(mails, F.lower)))
    return F.array_distinct(F.concat(*parts))


def unfenced(text: Column) -> Column:
    """A text without the fence that a code block has around it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")


def first_object(text: Column) -> Column:
    """What stands between the first opening and the last closing brace, else ''."""
    return F.regexp_extract(unfenced(text), r"(?s)(\{.*\})", 1)


def lenient(text: Column, schema: str) -> Column:
    """A JSON object from a text that may have a fence or words around it, single quotes, comments or commas before closing brackets; null where nothing helps."""
    clean = F.regexp_replace(F.regexp_replace(first_object(text), r"(?m)//[^\n\"]*$", ""), r",\s*([}\]])", "$1")
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    read = F.from_json(clean, schema, options)
    return F.when(F.contains(clean, F.lit("{")), read)


def rescued_items(text: Column, key: str = "findings") -> Column:
    """Whole objects (as texts) of the array under ``key`` in a JSON text that is cut off: up to three levels of braces each."""
    inner = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
    after = F.regexp_extract(unfenced(text), rf"(?s)\"{key}\"\s*:\s*\[(.*)$", 1)
    return F.regexp_extract_all(after, F.lit(inner), 0)


def leaves(rows: DataFrame, key: str, value: str, depth: int = 8) -> DataFrame:
    """(key, path, value) of all scalar leaves of JSON texts, down to ``depth`` levels; one pass a level, while there is one.

    Members of an array have its numbers as names.  Deeper values stay as they are told.
    """
    level, out = rows.select(key, F.lit("").alias("path"), F.col(value).alias("value")), []
    nested = lambda: F.col("value").rlike(r"^\s*[\[{]")
    for at in range(depth):
        out.append(level.where(~nested() & F.col("value").isNotNull()))
        inner = level.where(nested())
        named = inner.where(F.col("value").rlike(r"^\s*\{")).select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
        numbered = inner.where(F.col("value").rlike(r"^\s*\[")).select(key, "path", F.posexplode(F.from_json("value", "array<string>")).alias("name", "value"))
        level = named.unionByName(numbered.withColumn("name", F.col("name").cast("string"))).select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "name").alias("path"), "value")
        if level.isEmpty():
            break
    flat = out[0]
    for more in [*out[1:], level]:
        flat = flat.unionByName(more)
    return flat
