"""Merkle manifest of a table: a tree for each language, and one over the languages' roots.

Leaves are digests of rows.  In the order of (language, doc_id) they are dealt to blocks of consecutive places.  A block is a
sparse forest: nodes keyed by (tree, level, index), of which those whose siblings lie elsewhere are unresolved.  Forests
are merged by ``merged``: whenever a run of siblings is complete (their number follows from the tree's size alone) its
parent takes their place, so it doesn't matter which blocks meet first.  Blocks are reduced in rounds of ``FAN`` blocks, a
tree of grouped jobs; each round keeps the siblings that it resolved as a table, since proofs need them.  A block of any size
leaves a few nodes a level at most, so a round's groups are small, and no digest but the root comes to the driver.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, in_order, stored, with_small

#: Consecutive leaves of a block, and forests that a merge takes.
BLOCK, FAN = 1 << 12, 64
#: The tree over the roots of the others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row's ``FIELDS``: each is its bytes' count, a colon and itself, or a dash if null."""
    text = lambda c: c.cast("string")
    coded = [F.coalesce(F.concat(F.octet_length(text(values[f])).cast("string"), F.lit(":"), text(values[f])), F.lit("-")) for f in FIELDS]
    return F.sha2(F.encode(F.concat(*coded), "UTF-8"), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    return (n + (1 << level) - 1) >> level


def merged(forests: list[dict], sizes: dict[int, int]) -> tuple[dict, dict, dict]:
    """(unresolved nodes, all nodes, parent of each resolved one) of forests {(tree, level, index): digest}; ``sizes`` has the trees' leaves.

    The root of a language's tree becomes the leaf of that number of the tree over them.
    """
    known: dict = {}
    for forest in forests:
        known.update(forest)
    live, up, work = dict(known), {}, sorted(known)
    while work:
        node = work.pop()
        if node not in live:
            continue
        tree, level, index = node
        n = width(sizes[tree], level)
        if n == 1 and tree == TOP:
            continue
        run = [node] if n == 1 else [(tree, level, i) for i in (index & ~1, index | 1) if i < n]
        if any(x not in live for x in run):
            continue
        above = (TOP, 0, tree) if n == 1 else (tree, level + 1, index >> 1)
        known[above] = live[node] if n == 1 else digest([live[x] for x in run])
        for x in run:
            del live[x]
            up[x] = above
        live[above] = known[above]
        work.append(above)
    return live, known, up


def climb(node: tuple, known: dict, up: dict) -> tuple[list[str], tuple, str | None]:
    """(steps from a node to what is unresolved above it, that node, its language's root if it is passed).

    A step is the sibling's digest after ``<`` or ``>`` for its side, or a dash where a node has none.
    """
    steps, root = [], None
    while node in up:
        above = up[node]
        if above[0] == node[0]:
            other = (node[0], node[1], node[2] ^ 1)
            steps.append("-" if other not in known or up.get(other) != above else "<>"[node[2] % 2 == 0] + known[other])
        else:
            root = known[node]
        node = above
    return steps, node, root


def fold(start: str, steps: list[str]) -> str:
    """Root that follows from a leaf and its steps."""
    for s in steps:
        start = digest([s[1:], start] if s[0] == "<" else [start, s[1:]])
    return start


NODE = "tree long, level int, index long, n long, digest string"


def forest(rows: pd.DataFrame) -> tuple[dict, dict]:
    """(forest, sizes of its trees) of rows like ``NODE``."""
    keys = zip(rows["tree"].tolist(), rows["level"].tolist(), rows["index"].tolist())
    return dict(zip(keys, rows["digest"])), dict(zip(rows["tree"].tolist(), rows["n"].tolist()))


def placed(docs: DataFrame, tamper: Column) -> tuple[DataFrame, int]:
    """(stored leaves (block, tree, level, index, n, digest, doc_id, other) in blocks, how many trees).

    ``other`` is the leaf with ``tamper`` in place of n_chars where that differs.
    """
    values = {f: F.col(f) for f in FIELDS}
    own, changed = leaf(values), leaf(values | {"n_chars": tamper})
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang"), own.alias("digest"), F.when(~tamper.eqNullSafe(F.col("n_chars")), changed).alias("other"))
    rows = stored(in_order(leaves, [], ["_lang", F.asc_nulls_first("doc_id"), "digest"]))
    trees = in_order(rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.octet_length(F.first("_lang")).alias("bytes")), [], ["_lang"]).withColumnRenamed("_at", "tree")
    trees = stored(trees)
    n, size = trees.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    joined = with_small(rows, trees.drop("bytes"), "_lang", "inner", NARROW_ROWS if (size or 0) < 10_000_000 else 0)
    return stored(joined.select(F.expr(f"_at DIV {BLOCK}").alias("block"), "tree", F.lit(0).alias("level"), (F.col("_at") - F.col("first")).alias("index"), "n", "digest", "doc_id", "other")), n


def reduced(leaves: DataFrame, trees: int) -> tuple[DataFrame, str]:
    """(stored (block, tree, level, index, steps, subroot): how each node that a block left goes on to the root; the root)."""

    def left(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes = forest(rows)
        live, _, _ = merged([nodes], sizes | {TOP: trees})
        return pd.DataFrame([(rows["block"].iloc[0], *k, sizes.get(k[0], trees), d) for k, d in live.items()], columns=["block", "tree", "level", "index", "n", "digest"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes = forest(rows)
        live, known, up = merged([nodes], sizes | {TOP: trees})
        out = [("node", *k, sizes.get(k[0], trees), d, None, None, None, None, None) for k, d in live.items()]
        for k in nodes:
            steps, top, root = climb(k, known, up)
            out.append(("step", *k, None, None, steps, root, *top))
        made = pd.DataFrame(out, columns=["kind", "tree", "level", "index", "n", "digest", "steps", "subroot", "to_tree", "to_level", "to_index"])
        return made.assign(group=rows["group"].iloc[0]).astype({c: "Int64" for c in ("n", "to_tree", "to_level", "to_index")})

    nodes = stored(leaves.select("block", *("tree", "level", "index", "n", "digest")).groupBy("block").applyInPandas(left, f"block long, {NODE}"))
    ways = nodes.select("block", "tree", "level", "index", F.expr("cast(array() AS array<string>)").alias("steps"), F.lit(None).cast("string").alias("subroot"), *(F.col(c).alias(f"to_{c}") for c in ("tree", "level", "index")))
    top = nodes.agg(F.max("block")).first()[0] or 0
    nodes = nodes.withColumnRenamed("block", "group")
    while True:
        top //= FAN
        made = stored(nodes.withColumn("group", F.expr(f"group DIV {FAN}")).groupBy("group").applyInPandas(meet, f"group long, kind string, {NODE}, steps array<string>, subroot string, to_tree long, to_level int, to_index long"))
        nodes = made.where("kind = 'node'").select("group", "tree", "level", "index", "n", "digest")
        step = made.where("kind = 'step'").select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("index").alias("to_index"), F.col("steps").alias("more"), F.col("subroot").alias("root"), *(F.col(f"to_{c}").alias(f"new_{c}") for c in ("tree", "level", "index")))
        ways = ways.join(step, ["to_tree", "to_level", "to_index"]).select("block", "tree", "level", "index", F.concat("steps", "more").alias("steps"), F.coalesce("subroot", "root").alias("subroot"), *(F.col(f"new_{c}").alias(f"to_{c}") for c in ("tree", "level", "index")))
        if top == 0:
            found = nodes.select("digest").take(1)
            return stored(ways.select("block", "tree", "level", "index", "steps", "subroot")), found[0][0] if found else ""


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row of ``docs`` (columns ``FIELDS``; others are ignored).

    ``proof`` has the steps of ``climb`` to the root.  ``tamper`` is what n_chars is meanwhile held to be (by default what it is):
    ``folded_root`` follows from the row as it then is and the proof, and ``verified`` tells whether that is the root.
    Null fields are dashes, a null language comes first and a null doc_id before others; equal doc_ids are ordered by
    their leaves, and a repeated row is a leaf each time.  An empty table has no rows.
    """
    leaves, trees = placed(docs, F.col("n_chars") if tamper is None else tamper)
    ways, root = reduced(leaves, trees)

    def prove(rows: pd.DataFrame, on: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes = forest(rows)
        _, known, up = merged([nodes], sizes | {TOP: trees})
        beyond = {k: (list(s), r) for k, s, r in zip(zip(on["tree"].tolist(), on["level"].tolist(), on["index"].tolist()), on["steps"], on["subroot"])}
        out = []
        for key, doc, own, other in zip(nodes, rows["doc_id"].tolist(), rows["digest"], rows["other"]):
            steps, top, subroot = climb(key, known, up)
            more, later = beyond[top]
            steps = steps + more
            folded = fold(other if isinstance(other, str) else own, steps)
            out.append((doc, own, subroot or later, root, steps, folded, folded == root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"])

    kind = docs.schema["doc_id"].dataType
    rows = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))  # whole numbers beside nulls would come as fractions
    made = rows.groupBy("block").cogroup(ways.groupBy("block")).applyInPandas(prove, "doc_id string, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))
