"""Substring search of many names in many texts, as joins.

Every name has an anchor: the rarest of its three-letter grams in the texts (a name of one or two letters is its own gram).
Texts are cut into overlapping stretches, and only their grams that are anchors are kept; equal grams make candidates,
which are verified on whole texts.  So a pair is looked at only where the name's rarest gram is in the text, whatever
stands around it: blanks, other letters, nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import saved

GRAM = 3
#: Letters of a stretch.
STRETCH = 1 << 16
#: Rows of three short strings that may be broadcast.
BROADCAST_ROWS = 300_000
#: Fixed value: what may not stand on either side of a file's name.
NAME_BORDER = "a-z0-9_.-"


def grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of these lengths of a text."""
    # a match of no width at every letter: one pass over the text, where substring() counts letters from its beginning each time
    of = lambda n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    return F.array_distinct(F.concat(*map(of, sizes)))


def small(table: DataFrame) -> DataFrame:
    """The saved ``table``, to be broadcast while its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mentions(texts: DataFrame, names: DataFrame, border: str = "") -> DataFrame:
    """(id, name) of every text of ``texts`` (id, text) that holds a name of ``names`` (name), letter case aside.

    ``border`` is a class of letters (as within brackets of a pattern) that may stand neither before nor after the name.  Names that overlap
    are found each.  Null texts hold nothing; null and empty names are in no text; ids name one text each; repeated names are one.
    """
    wanted = saved(names.select(F.lower("name").alias("name")).where("name <> ''").distinct())
    short = F.least(F.length("name"), F.lit(GRAM))
    sizes = sorted(r[0] for r in wanted.select(short.alias("n")).distinct().collect())  # three at most
    if not sizes:
        return texts.select("id", F.lit("").alias("name")).where("false")
    lowered = texts.select("id", F.lower("text").alias("text")).where("text <> ''")
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) DIV {STRETCH} AS int)")), lambda k: F.substring(F.col("text"), k * STRETCH + 1, F.lit(STRETCH + GRAM - 1)))
    pieces = lowered.select("id", F.explode(parts).alias("part"))
    each = lambda: pieces.select("id", F.explode(grams(F.col("part"), sizes)).alias("gram"))
    own = saved(wanted.select("name", F.explode(F.when(F.length("name") < GRAM, F.array("name")).otherwise(grams(F.col("name"), [GRAM]))).alias("gram")))
    asked = saved(own.select("gram").distinct())
    # in how many stretches each gram of a name is: summed up in each task first, so what is shuffled is no more than these grams
    seen = each().join(small(asked), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = own.join(seen, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    anchors = saved(anchors)
    pairs = each().join(small(anchors), "gram").select("id", "name").distinct()
    literal = F.concat(F.lit("\\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inside = F.contains("text", "name")
    if border:
        inside = inside & F.regexp("text", F.concat(F.lit(f"(?:^|[^{border}])"), literal, F.lit(f"(?:[^{border}]|$)")))
    return pairs.join(lowered, "id").where(inside).select("id", "name")
