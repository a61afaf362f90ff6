"""Writers: state tables that are valid for one set of inputs, and packages without private texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a package must not tell: mail addresses, addresses, user folders, security identifiers (pattern, what stands for it).
PRIVATE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<address>"), (r"(?i)([\\/]users[\\/])[^\\/\s]+", "$1<user>"), (r"(?i)s-1-5-21(-[0-9]+)+", "<sid>"),
]


def write_state(df: DataFrame, folder: str, name: str, inputs: DataFrame) -> None:
    """Write a table of state beside the digest of the ``inputs`` (path, sha256) that it was made of."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    fingerprint(inputs).write.mode("overwrite").parquet(f"{folder}/{name}.inputs")


def _folded(text):
    """Part of an order-free digest of rows."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(inputs: DataFrame) -> DataFrame:
    """One row: an order-free digest of (path, sha256) rows and their number; rows are folded where they are."""
    return inputs.agg(F.coalesce(F.sum(_folded(F.concat_ws("|", "path", "sha256"))), F.lit(0)).cast("string").alias("digest"), F.count(F.lit(1)).alias("files"))


def read_state(spark: SparkSession, folder: str, name: str, inputs: DataFrame) -> DataFrame | None:
    """The table of state, or None where there is none or its inputs were others."""
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.parquet(f"{folder}/{name}.inputs").first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{folder}/{name}") if known == fingerprint(inputs).first() else None


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without private texts in these columns."""
    for c in columns:
        clean = F.col(c)
        for pattern, instead in PRIVATE:
            clean = F.regexp_replace(clean, pattern, instead)
        df = df.withColumn(c, clean)
    return df


def write_package(tables: dict[str, DataFrame], folder: str, private: dict[str, list[str]]) -> DataFrame:
    """Write tables as JSON lines without private texts; the manifest (name, n_rows, digest), which is written too.

    The digest is order-free, so it tells of changed rows and not of how they were dealt.
    """
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        clean = redacted(df, private.get(name, []))
        clean.write.mode("overwrite").json(f"{folder}/{name}")
        rows.append((name, *clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(_folded(F.to_json(F.struct(*clean.columns)))), F.lit(0)).cast("string")).first()))
    manifest = spark.createDataFrame(rows, "name string, n_rows long, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that still hold a private text in one of these columns; a package must have none."""
    return df.where(F.concat_ws(" ", *columns).rlike("|".join(f"(?:{p})" for p, _ in PRIVATE[:2] + PRIVATE[3:])))
