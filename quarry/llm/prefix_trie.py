"""Trie of conversation prefixes: which turns conversations share from their beginning.

Every turn has a digest; a prefix's digest is the running sum, in four 32-bit lanes, of the digests of (place, turn), so a long
conversation is cut over many tasks.  A node is a distinct prefix and belongs to its least conversation.  Ownership is
monotone: whoever owns a prefix owns all longer ones of its own.  So each conversation's first owned depth is found by binary
search, in stretches of ``STRETCH`` depths: every turn of the search is one join of all stretches with the least owner of
each *shared* prefix (a prefix that only one conversation has is its own).  From there on its nodes are a chain.  Chains hang on chains; a
chain's sums go up to the shared prefixes above it in one grouping, and along itself by running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NARROW_ROWS, in_order, stored, with_small

#: Depths of a search, a power of two.
STRETCH = 64
#: Conversations that end at a node whose ids are gathered at once.
ENDS = 4096
LANES = 4


def crc(c: Column) -> Column:
    """Unsigned CRC-32 of a number's decimal digits."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored turns (conv_id, at, mark, bytes), stored conversations (conv_id, n)).

    ``at`` is a turn's place from 0 in the order of (turn, null first, digest), ``mark`` the digest of its role and text.
    A null role or text is empty.  Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    turns = stored(in_order(turns, ["conv_id"], [F.asc_nulls_first("turn"), "mark"]).select("conv_id", F.col("_at").alias("at"), "mark", "bytes"))
    return turns, stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))


def rebuilt(turns: DataFrame, convs: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their ``group`` does, like ``numbered``.

    Conversation c takes the first h turns of c - c % ``group`` (all if it has fewer, none if it isn't there), h = CRC-32 of c modulo ``most`` + 1,
    and then its own after its first h.
    """
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (crc(F.col("conv_id")) % (most + 1)).alias("h"), "n")
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("theirs")), "base", "left")
    plan = stored(plan.withColumn("head", F.least("h", F.coalesce("theirs", F.lit(0)))))
    begin = turns.where((F.col("at") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    first = plan.select("conv_id", "base", "head").join(begin, "base").where("at < head").select("conv_id", "at", "mark", "bytes")
    rest = with_small(turns, plan.select("conv_id", "h", "head"), "conv_id", "inner", NARROW_ROWS).where("at >= h")
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "mark", "bytes")
    return stored(first.unionByName(rest)), plan.select("conv_id", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Stored (conv_id, depth, d1, d2, bytes): digests of the prefixes of one turn and more; ``bytes`` is the last turn's."""
    hexed = F.sha2(F.encode(F.concat(F.col("at").cast("string"), F.lit(":"), "mark"), "UTF-8"), 256)
    lanes = turns.select("conv_id", "at", "bytes", hexed.alias("_hex")).select("conv_id", "at", "bytes", *(F.conv(F.substring("_hex", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"l{i}") for i in range(LANES)))
    summed = in_order(lanes, ["conv_id"], ["at"], tuple(f"l{i}" for i in range(LANES)))
    low = lambda i: F.col(f"_sum_l{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    pack = lambda i: F.shiftleft(low(i), 32).bitwiseOR(low(i + 1))
    return stored(summed.select("conv_id", (F.col("at") + 1).alias("depth"), pack(0).alias("d1"), pack(2).alias("d2"), "bytes"))


PREFIX = ["depth", "d1", "d2"]


def first_owned(path: DataFrame, shared: DataFrame) -> DataFrame:
    """Stored (conv_id, first): the least depth from 1 on that a conversation owns, for those that own one.

    ``path`` is what ``prefixes`` gave, ``shared`` (depth, d1, d2, owner) has the least conversation of each prefix with several.
    """
    low = (F.col("depth") - 1 - (F.col("depth") - 1) % STRETCH).alias("low")
    cut = path.groupBy("conv_id", low).agg(F.array_sort(F.collect_list(F.struct(*PREFIX))).alias("ds"))
    # the answer lies in [a, b]; b = size stands for none
    state = cut.withColumns({"a": F.lit(0), "b": F.size("ds")})
    rows = shared.count()
    table = shared.select(*(F.col(c).alias(f"p_{c}") for c in PREFIX), "owner")
    table = F.broadcast(table) if rows <= NARROW_ROWS else table.hint("merge")
    for _ in range(STRETCH.bit_length()):
        probed = state.withColumn("mid", F.expr("(a + b) DIV 2")).withColumn("probe", F.when(F.col("a") < F.col("b"), F.expr("ds[mid]")))
        joined = probed.join(table, (F.col("probe.depth") == F.col("p_depth")) & (F.col("probe.d1") == F.col("p_d1")) & (F.col("probe.d2") == F.col("p_d2")), "left")
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        open_ = F.col("a") < F.col("b")
        state = joined.select("conv_id", "low", "ds", F.when(open_ & ~owned, F.expr("mid + 1").cast("int")).otherwise(F.col("a")).alias("a"), F.when(open_ & owned, F.col("mid").cast("int")).otherwise(F.col("b")).alias("b"))
    found = state.where(F.col("a") < F.size("ds")).groupBy("conv_id").agg(F.min(F.col("low") + F.col("a") + 1).alias("first"))
    return stored(found)


def ends(at: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): the conversations ``at`` (ending, conv_id, depth) that end at each node, ascending, as one comma-joined string's SHA-256.

    Few are gathered at once.  A node where more end has them joined in stretches of ids, and these run through one digest in order,
    which can't be split but holds no more than one stretch.
    """
    import pyarrow as pa

    sizes = stored(at.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ENDS))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list("ending")), lambda x: x.cast("string")), ",")
    few = with_small(at, sizes, ["conv_id", "depth"], "left_anti", NARROW_ROWS)
    small = few.groupBy("conv_id", "depth").agg(F.sha2(joined(), 256).alias("ends"))
    if sizes.isEmpty():
        return small
    many = with_small(at, sizes, ["conv_id", "depth"], "inner", NARROW_ROWS)
    parts = many.groupBy("conv_id", "depth", F.floor(F.col("ending") / ENDS).alias("part")).agg(joined().alias("ids"))

    def digest(batches):
        from hashlib import sha256

        now, made = None, None
        for batch in batches:
            out = []
            for c, d, ids in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "ids"))):
                if (c, d) == now:
                    made.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, made.hexdigest()))
                    now, made = (c, d), sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends"), o)) for o in out], pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())]))
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends"), (*now, made.hexdigest())))])

    large = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "ids").mapInArrow(digest, "conv_id long, depth long, ends string")
    return small.unionByName(large)


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, at, mark, bytes) and ``convs`` (conv_id, n; those without turns too) are as ``numbered`` gives them.  Equal
    conversations end at one node; one without turns ends at the root; no conversations, no nodes.
    """
    path = prefixes(turns)
    shared = stored(path.groupBy(*PREFIX).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1"))
    all_convs, root = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    first = first_owned(path, shared.select(*PREFIX, "owner"))
    own = with_small(path, first, "conv_id", "left", NARROW_ROWS).withColumn("first", F.coalesce("first", F.lit(2**31)))
    lowest = F.lit(root).cast("long")
    rooted = lambda c: F.when(F.col(c) == 0, lowest)
    # what is above a chain belongs to others: owners of the prefixes that it shares
    above = stored(own.where("depth < first").select("conv_id", *PREFIX, "first"))
    held = stored(own.where("depth >= first").join(shared.select(*PREFIX, "n_convs"), PREFIX, "left").select("conv_id", "depth", "first", F.coalesce("n_convs", F.lit(1)).alias("n_convs"), "bytes"))
    top = convs.select("conv_id").where(F.col("conv_id") == lowest).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("first"), F.lit(all_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    chain = held.unionByName(top)
    # chains of one turn hang on the root, others on the owner of the prefix before their first
    hung = above.where("depth = first - 1").join(shared.select(*PREFIX, "owner"), PREFIX).select("conv_id", "owner", "depth")
    flat = held.where("depth = first AND first = 1").where(F.col("conv_id") != lowest).select("conv_id", lowest.alias("owner"), F.lit(0).cast("long").alias("depth"))
    hung = stored(hung.unionByName(flat))
    children = hung.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("hung"))
    last = held.groupBy("conv_id").agg(F.max("depth").alias("last"))
    last = last.unionByName(top.select("conv_id", F.col("depth").alias("last"))).groupBy("conv_id").agg(F.max("last").alias("last"))
    body = chain.join(children, ["conv_id", "depth"], "left").join(last, "conv_id")
    body = stored(body.select("conv_id", "depth", "first", "n_convs", (F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "last"))
    totals = stored(body.groupBy("conv_id").agg(F.sum("saved").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")))
    # every chain's sums at the shared prefixes above it; the root is above all but its own chain
    up = with_small(above.where("first < 2147483648"), totals, "conv_id", "inner", NARROW_ROWS).groupBy(*PREFIX).agg(F.sum("total").alias("more"), F.sum("leaf").alias("leaves"))
    up = up.join(shared.select(*PREFIX, "owner"), PREFIX).select(F.col("owner").alias("conv_id"), "depth", "more", "leaves")
    beyond = totals.where(F.col("conv_id") != lowest).agg(F.sum("total").alias("more"), F.sum("leaf").alias("leaves"))
    up = up.unionByName(beyond.select(lowest.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("leaves", F.lit(0)).alias("leaves")))
    below = in_order(body.withColumn("_down", -F.col("depth")), ["conv_id"], ["_down"], ("saved",))
    ended = convs.select("conv_id", F.col("n").alias("depth")).join(path.select("conv_id", *PREFIX), ["conv_id", "depth"], "left").join(shared.select(*PREFIX, "owner"), PREFIX, "left")
    ended = stored(ended.select(F.col("conv_id").alias("ending"), F.coalesce(rooted("depth"), "owner", "conv_id").alias("conv_id"), "depth"))
    parent = hung.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    keys = ["conv_id", "depth"]
    out = below.join(up, keys, "left").join(parent, keys, "left").join(totals.select("conv_id", "leaf"), "conv_id").join(ends(ended), keys, "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.col("_sum_saved") + F.coalesce("more", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """``nodes`` of the table ``conversations`` (conv_id, turn, role, text; other columns are ignored)."""
    return nodes(*numbered(conversations))
