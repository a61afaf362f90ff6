"""Readers of tool output: JSON, CSV, XML, text and binary, each to a DataFrame of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(tool, record_index, raw) of envelopes; their records are ``output``, ``records``, or ``entries`` or ``events`` of the output."""
    found = envelopes(spark.read.text(path, wholetext=True).select("value"))
    return found.select("tool", F.posexplode("records").alias("record_index", "raw"))


def envelopes(texts: DataFrame) -> DataFrame:
    """(tool, records, declared, error) of JSON texts (value): ``declared`` is the told number of records or else their number."""
    kind = "struct<tool_name:string,output:string,records:string,record_count:long,error:string>"
    read = texts.select(F.from_json("value", kind).alias("e"))
    listed = F.coalesce(*(F.from_json(F.get_json_object("e.output", p), "array<string>") for p in ("$", "$.records", "$.entries", "$.events")), F.from_json("e.records", "array<string>"), F.array().cast("array<string>"))
    return read.select(F.col("e.tool_name").alias("tool"), listed.alias("records"), F.coalesce("e.record_count", F.size(listed).cast("long")).alias("declared"), F.col("e.error").alias("error"))


def failed(found: DataFrame) -> DataFrame:
    """Envelopes that tell of an error and have no records."""
    return found.where("coalesce(error, '') <> '' AND size(records) = 0")


#: Beginnings of lines that tools write among their rows.
CHATTER = ("Volatility 3 Framework", "Progress:")


def ragged_csv(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Rows of CSV lines (value) of one file, in the order in which they were read.

    The header is the first line with two cells that is no chatter, or the line that equals ``header``; what stands before it, blank lines and
    chatter are skipped.  Quoted cells hold commas and doubled quotes; short rows are filled with '', and what is too much belongs to the last
    column.  A file without such a line has no rows (and needs ``header`` for its columns).
    """
    talk = F.lit(False)
    for c in CHATTER:
        talk = talk | F.startswith("value", F.lit(c))
    # each match takes one comma and the cell after it
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), 1), lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))
    read = lines.select(F.rtrim("value", F.lit("\r")).alias("value")).withColumn("_no", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~talk).select("_no", cells.alias("_cells"))
    asked = (F.size("_cells") >= 2) if header is None else F.col("_cells") == F.array(*map(F.lit, header))
    first = read.where(asked).orderBy("_no").limit(1).collect()  # one row
    names = header if header is not None else first[0]["_cells"] if first else ["value"]
    rows = read.where(F.col("_no") > first[0]["_no"]) if first else read.where("false")
    n = len(names)
    last = F.array_join(F.slice("_cells", n, F.greatest(F.size("_cells"), F.lit(n))), ",")
    return rows.select(*(F.coalesce(F.get("_cells", F.lit(k)) if k < n - 1 else last, F.lit("")).alias(c) for k, c in enumerate(names)))


def flat_tree(records: DataFrame, children: str = "__children") -> DataFrame:
    """(record, depth) of records (JSON text) and of what is nested in them under ``children``, which is dropped; one pass a level, until one is empty.

    Each level is saved, so none is read again for those below it.
    """
    inner = lambda df: df.select(F.explode(F.from_json(F.get_json_object("record", f"$.{children}"), "array<string>")).alias("record"))
    plain = lambda df, depth: df.select(F.to_json(F.map_filter(F.from_json("record", "map<string,string>"), lambda k, v: k != children)).alias("record"), F.lit(depth).alias("depth"))
    level, out = records.select("record"), []
    while not out or not level.isEmpty():
        out.append(plain(level, len(out)))
        level = saved(inner(level))
    flat = out[0]
    for more in out[1:]:
        flat = flat.unionByName(more)
    return flat


def first_source(spark: SparkSession, wanted: DataFrame, other: DataFrame, alias: str) -> DataFrame:
    """``wanted``, or where it has no rows ``other``, marked with the name that it stands for (``fallback_alias_of``), so that it is not counted twice."""
    empty = wanted.isEmpty()
    return (other if empty else wanted).withColumn("fallback_alias_of", F.lit(alias if empty else None).cast("string"))


def unique_sources(records: DataFrame, order: list[str]) -> DataFrame:
    """Records (tool, ...) without those of tools of ``order`` that an earlier tool of it also gave."""
    rank = F.create_map(*(x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))))
    best = records.agg(F.min(rank[F.col("tool")]).alias("best"))
    return records.join(F.broadcast(best)).where(rank[F.col("tool")].isNull() | (rank[F.col("tool")] == F.col("best"))).drop("best")  # one row


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files that were added, removed or modified between two tables of ``digests``."""
    both = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def matching_name(files: DataFrame, name: str) -> DataFrame:
    """Files (path) that end in ``name``, whatever the case and the direction of slashes."""
    return files.where(F.endswith(F.lower(F.translate("path", "\\", "/")), F.lit(name.replace("\\", "/").lower())))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, the header as names; broken rows are kept with nulls."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=True, escape='"')


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def text_records(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Groups of ``pattern`` in every line that matches it."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*(F.regexp_extract("value", pattern, k + 1).alias(n) for k, n in enumerate(names)))


def binary_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha1) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha1("content").alias("sha1"))
