"""Process chains: from each process up to the first ancestor that is known.

A parent is an instance of a process number, since numbers are used again.  Paths are doubled: each round joins every process with
what its farthest known ancestor knows, so a chain of n processes takes about log2(n) rounds.  What a path carries is of fixed
size: its length, its root, the last names, and a key of four remainders that two paths' keys give by a product and a sum,
so equal keys are equal sequences of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import normalise as N
from quarry.operators.graph import saved

#: Key: remainders by this prime of sums of names' numbers by powers of a base.
PRIME, BASES = 2**31 - 1, (1_000_003, 1_000_033, 1_000_037, 1_000_039)
#: Names of a chain's end that are kept.
TAIL = 6


def parents(processes: DataFrame) -> DataFrame:
    """(id, parent) of processes (id, pid, ppid, created): the last instance of the parent's number that began no later; null where none did.

    Of instances of one time the one of the highest id counts.  Unknown times are before all others.  No process is its own parent.
    """
    own = processes.select("id", "pid", "ppid", F.coalesce(F.col("created").cast("timestamp").cast("double"), F.lit(float("-inf"))).alias("at"))
    # an instance holds its number until the next one begins
    later = F.lead("at").over(Window.partitionBy("pid").orderBy("at", "id"))
    held = own.select(F.col("id").alias("parent"), F.col("pid").alias("ppid"), F.col("at").alias("since"), later.alias("until"))
    met = own.join(held, "ppid").where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))) & (F.col("id") != F.col("parent")))
    return own.select("id").join(met.select("id", "parent"), "id", "left")


def _doubled(known: DataFrame, rounds: int | None = None) -> DataFrame:
    """``known`` (id, up, n, root, tail, k*, p*, low) with ``up`` as far as ``rounds`` doublings lead, or until all are at their root."""
    turn = 0
    while turn != rounds and not known.where("up IS NOT NULL").isEmpty():
        turn += 1
        above = known.select(*(F.col(c).alias(f"a_{c}") for c in known.columns))
        met = known.join(above, known["up"] == F.col("a_id"), "left")
        both = F.col("a_id").isNotNull()
        mod = lambda c: c % PRIME
        known = saved(met.select(
            "id", F.col("a_up").alias("up"), (F.col("n") + F.coalesce("a_n", F.lit(0))).alias("n"), F.when(both, F.col("a_root")).otherwise(F.col("root")).alias("root"), F.least("low", "a_low").alias("low"),
            F.when(both, F.slice(F.concat("a_tail", "tail"), -F.least(F.lit(TAIL), F.size("a_tail") + F.size("tail")), F.lit(TAIL))).otherwise(F.col("tail")).alias("tail"),
            # the names above come first: theirs are multiplied by the base once for each name below
            *(F.when(both, mod(F.col(f"a_k{i}") * F.col(f"p{i}") + F.col(f"k{i}"))).otherwise(F.col(f"k{i}")).alias(f"k{i}") for i in range(len(BASES))),
            *(F.when(both, mod(F.col(f"a_p{i}") * F.col(f"p{i}"))).otherwise(F.col(f"p{i}")).alias(f"p{i}") for i in range(len(BASES)))))
    return known


def chains(processes: DataFrame) -> DataFrame:
    """(id, length, root, tail, chain_key, cyclic) of processes (id, pid, ppid, name, created); ids are unique numbers.

    ``length`` counts the processes from the root to this one, ``tail`` has the last names (normal form) joined by ``->``, and equal
    ``chain_key``s mean equal names in equal order from the root on.  Where parents lead round in a circle (only processes of one time
    can), the circle's least id is taken for its root (``cyclic``).
    """
    names = processes.select("id", N.process_name(F.col("name")).alias("name"))
    digest = F.md5(F.col("name"))
    number = lambda i: F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long")
    linked = saved(names.join(parents(processes), "id"))
    begin = lambda df: df.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("id").alias("root"), F.array("name").alias("tail"), *(number(i).alias(f"k{i}") for i in range(len(BASES))), *(F.lit(b).cast("long").alias(f"p{i}") for i, b in enumerate(BASES)), F.col("id").alias("low"))
    n = max(1, linked.count())
    known = _doubled(begin(linked), n.bit_length() + 1)
    lost = saved(known.where("up IS NOT NULL").select("id", "up"))
    if lost.isEmpty():
        return _named(known, F.lit(False))
    # after so many steps ``up`` lies on a circle, and the least id that is met from there on is the circle's
    low = known.join(lost.select(F.col("up").alias("id")).distinct(), "id").select(F.col("low").alias("id")).distinct().withColumn("cut", F.lit(True))
    whole = linked.join(low, "id", "left").select("id", "name", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"))
    again = _doubled(begin(saved(whole)))
    return _named(again.join(low.select(F.col("id").alias("root"), "cut"), "root", "left"), F.col("cut").isNotNull())


def _named(known: DataFrame, cyclic) -> DataFrame:
    key = F.concat(*(F.lpad(F.lower(F.hex(f"k{i}")), 8, "0") for i in range(len(BASES))))
    return known.select("id", F.col("n").alias("length"), "root", F.array_join("tail", "->").alias("tail"), key.alias("chain_key"), cyclic.alias("cyclic"))
