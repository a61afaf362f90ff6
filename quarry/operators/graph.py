"""Entity graph: connected components by least labels."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``; only a local session may go without that setting."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif re.match(r"local(\[|$)", context.master):
            base = tempfile.mkdtemp(prefix="quarry-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:") :]
    elif "://" not in base:
        base = "file://" + base
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read back: its lineage is cut, and so is what the planner infers from it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b): the least node that each is joined to.

    Labels spread by neighbours and by labels of labels, so long chains take few rounds; each
    round is saved in the shared folder.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = saved(step.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old"))
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels
