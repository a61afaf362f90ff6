"""Secret scans: fixed patterns and character Markov models, in DataFrame functions alone.

Two first-order character models are trained, one from random strings (hexadecimal and
base64 forms of digests, labelled "random") and one from identifiers (words of sampled
documents alone, joined by underscores or in camel case, labelled "ordinary").  A long token whose
log-likelihood ratio is high reads as random and becomes a span beside those of
the patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Patterns of the base kinds in the order of the kinds (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Documents and random strings that the models are trained on.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 20_000
#: A token is random above this ratio in all, and on average for a character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.6
MASK = "<secret>"

SPAN = "struct<start:int,kind:int,end:int>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int, keep: str) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves alternate, so a fold
    over their lengths gives every place.  ``keep`` is SQL over ``x.m`` (a match).
    """
    p = _quoted(pattern)
    fold = f"""aggregate(
        zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, m) -> named_struct('gap', char_length(gap), 'm', m)),
        named_struct('at', 0, 'out', cast(array() AS array<{SPAN}>)),
        (s, x) -> named_struct('at', s.at + x.gap + coalesce(char_length(x.m), 0), 'out',
            CASE WHEN x.m IS NOT NULL AND {keep}
            THEN concat(s.out, array(named_struct('start', s.at + x.gap, 'kind', {kind}, 'end', s.at + x.gap + char_length(x.m)))) ELSE s.out END),
        s -> s.out)"""
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {fold} ELSE cast(array() AS array<{SPAN}>) END")


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios random / ordinary of all (character, next) pairs, row by row.

    At most ``SAMPLE_DOCS`` distinct documents, the first in the order of a hash of id and text,
    and ``SAMPLE_RANDOM`` random strings are counted, each count starting at one half.
    Only the table of pairs, whose size is fixed by the alphabet, comes to the driver.
    """
    spark = docs.sparkSession
    hashed = docs.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    words = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select(F.expr("filter(regexp_extract_all(text, '[A-Za-z][a-z]+', 0), w -> length(w) > 1)").alias("w")).where("size(w) > 0")
    ordinary = words.select(F.explode(F.expr("""flatten(array(w,
        zip_with(w, slice(w, 2, size(w)), (a, b) -> concat(a, '_', coalesce(b, 'id'))),
        zip_with(w, slice(w, 2, size(w)), (a, b) -> concat(lower(a), initcap(coalesce(b, 'id')))),
        zip_with(w, slice(w, 2, size(w)), (a, b) -> concat(upper(a), '_', upper(coalesce(b, 'id')))),
        zip_with(w, slice(w, 2, size(w)), (a, b) -> concat(a, '-', coalesce(b, 'id'), '/', a))))""")).alias("t")).withColumn("random", F.lit(0))
    noise = spark.range(SAMPLE_RANDOM).select(F.expr("sha2(cast(id AS string), 256)").alias("h"))
    noise = noise.select(F.explode(F.expr("array(h, rtrim('=', base64(unhex(h))))")).alias("t")).withColumn("random", F.lit(1))
    pairs = ordinary.unionByName(noise).where("length(t) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(t) - 1), i -> substring(t, i, 2))")).alias("pair"))
    size = len(ALPHABET)
    counts = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for row in pairs.groupBy("random", "pair").count().collect():
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            counts[row["random"]][a][b] += row["count"]
    ratio = []
    for a in range(size):
        plain, rand = sum(counts[0][a]), sum(counts[1][a])
        ratio += [round(math.log(counts[1][a][b] / rand) - math.log(counts[0][a][b] / plain), 3) for b in range(size)]
    return ratio


def find(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with ``spans`` array<struct<start, kind, end>> sorted by start, then kind.

    ``kind`` counts in ``KINDS``; places are code points, ends exclusive.  Null and
    empty texts have none; other columns stay, a column ``spans`` is replaced; a row
    is scanned by itself, whatever its length, so no shuffle and no hot group.
    """
    size = len(ALPHABET)
    table = "array(" + ",".join(f"{x}D" for x in ratios) + ")"
    letter = lambda i: f"instr('{ALPHABET}', substring(x.m, {i}, 1))"
    score = f"aggregate(sequence(1, char_length(x.m) - 1), 0D, (t, i) -> t + element_at({table}, ({letter('i')} - 1) * {size} + {letter('i + 1')}))"
    text = "coalesce(text, '')"
    value = f"char_length(regexp_extract(x.m, {_quoted(ASSIGN)}, 2)) >= 8"
    base = F.concat(_spans(text, ASSIGN, 0, value), _spans(text, ACCESS, 1, "true"), _spans(text, HEX, 2, "true"))
    judged = f"({score}) >= greatest({LEAST_RATIO}D, {LEAST_MEAN}D * char_length(x.m))"
    mine, random = unused(docs, "_base"), unused(docs, "_random")
    found = docs.withColumn(mine, base).withColumn(random, _spans(text, TOKEN, 3, judged))
    apart = F.expr(f"filter({random}, r -> NOT exists({mine}, b -> b.start < r.end AND r.start < b.end))")
    return found.withColumn("spans", F.array_sort(F.concat(mine, apart))).drop(mine, random)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(found: DataFrame) -> DataFrame:
    """Texts with every span replaced by ``MASK`` (overlapping spans once); ``spans`` goes."""
    fold = f"""CASE WHEN size(spans) = 0 THEN text ELSE aggregate(spans, named_struct('at', 0, 'out', ''),
        (s, x) -> CASE WHEN x.start < s.at THEN named_struct('at', greatest(s.at, x.end), 'out', s.out)
            ELSE named_struct('at', x.end, 'out', concat(s.out, substring(text, s.at + 1, x.start - s.at), '{MASK}')) END,
        s -> concat(s.out, substring(text, s.at + 1))) END"""
    return found.withColumn("text", F.expr(fold)).drop("spans")
