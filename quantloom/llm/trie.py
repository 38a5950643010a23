"""Prefix trie of conversations by prefix doubling.

Turns get dense names, then pairs of neighbouring blocks of 1, 2, 4, ... turns
do, one join for each doubling: equal blocks have equal names. The prefix of d
turns is made of one block for each binary digit of d, the largest first, so it
is named by pairing the prefix without d's lowest digit with a block of that
size: one join for each digit. Conversations with the same name at depth d share
a node. Sums over subtrees double as well: a node that knows the sum of its
descendants less than 2^k below it takes those of the nodes exactly 2^k below.

No step is by conversation or by node as a whole: a conversation of very many
turns and a node of very many members are rows with keys of their own. Names
meet the many rows of a common turn in joins that Spark splits (adaptive
execution); counts are added up before they move.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a number from 0 for each row: in the order of its partitions
    and of the rows within. One count a partition comes to the driver."""
    made = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(made.groupBy(part.alias("p")).count().collect())
    ends = [0, *accumulate(n for _, n in sizes)]
    before = df.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, ends, strict=False)], "_p long, _n long")
    place = F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return made.join(F.broadcast(before), part == F.col("_p")).select(*df.columns, place.alias(name))


def turns(docs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), key (tells role and text), chars (code points of the text).

    Turns are in the order of turn_col (null first), equal ones in that of their
    keys. Null roles and texts are empty; rows without a conversation are in
    none. Texts stay where they are: keys, SHA-256 digests, stand for them.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = docs.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    order = ["conv", "turn", "key"]
    placed = numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order), "place")
    first = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return cut(placed.join(first, "conv").select("conv", (F.col("place") - F.col("first")).alias("pos"), "key", "chars"))


def _named(pairs: DataFrame) -> DataFrame:
    """pairs with a dense name for each distinct (a, b), in their place."""
    pairs = cut(pairs)
    names = numbered(pairs.select("a", "b").distinct(), "name")
    return cut(pairs.join(names, ["a", "b"]).drop("a", "b"))


def blocks(t: DataFrame) -> list[DataFrame]:
    """conv, i, name: of blocks of 1, 2, 4, ... turns, as long as there are two of a size."""
    names = numbered(t.select("key").distinct(), "name")
    levels = [cut(t.join(names, "key").select("conv", F.col("pos").alias("i"), "name"))]
    while True:
        half = F.when(F.col("i") % 2 == 0, F.col("name")), F.when(F.col("i") % 2 == 1, F.col("name"))
        pairs = levels[-1].groupBy("conv", F.shiftright("i", 1).alias("j")).agg(F.max(half[0]).alias("a"), F.max(half[1]).alias("b"))
        found = _named(pairs.where("a is not null and b is not null").withColumnRenamed("j", "i"))
        if found.isEmpty():
            return levels
        levels.append(found)


def prefixes(t: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv, d, name: of the first d turns, for each d from 1; names tell prefixes of one d."""
    spark = t.sparkSession
    whole = [level.where("i = 0").select("conv", F.lit(1 << k).cast("long").alias("d"), "name") for k, level in enumerate(levels)]
    every = None
    for k, level in enumerate(levels):
        sized = level.select("conv", F.lit(1 << k).cast("long").alias("low"), "i", F.col("name").alias("b"))
        every = sized if every is None else every.union(sized)
    last = None
    for x in whole:
        last = x if last is None else last.union(x)
    found = last
    d = t.select("conv", (F.col("pos") + 1).alias("d")).withColumn("low", F.col("d").bitwiseAND(-F.col("d")))
    d = d.withColumns({"rest": F.col("d") - F.col("low"), "i": (F.col("d") / F.col("low")).cast("long") - 1, "digits": F.bit_count("d")})
    for digits in range(2, len(levels) + 1):
        mine = d.where(F.col("digits") == digits)
        head = last.select("conv", F.col("d").alias("rest"), F.col("name").alias("a"))
        last = _named(mine.join(head, ["conv", "rest"]).join(every, ["conv", "low", "i"]).select("conv", "d", "a", "b"))
        found = found.union(last)
    return found if levels else spark.createDataFrame([], "conv long, d long, name long")


def trie(t: DataFrame, convs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of all prefixes of t (see turns()), and the node at which each conversation ends.

    Nodes: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree, each node's members but one times the code points of its
    last text). Ends: conv, conv_id, depth. convs: conv, all conversations, also
    those without turns; without any there are no nodes. Repeated conversations
    are members each; the root has no text and all conversations.
    """
    spark = t.sparkSession
    t = cut(t)
    size = t.groupBy("conv").agg((F.max("pos") + 1).alias("depth"))
    size = cut((size if convs is None else convs.select("conv").distinct().join(size, "conv", "left")).select("conv", F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
    path = cut(prefixes(t, blocks(t)))
    shared = path.groupBy("d", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    shared = cut(shared)
    root = size.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("deepest")).where("n_convs > 0")
    top = root.first()
    top_id, deepest = (top.conv_id, top.deepest) if top else (None, 0)
    # where each conversation is at each depth: a node is told by its smallest member and its depth
    at = path.join(shared.select("d", "name", "conv_id"), ["d", "name"]).select("conv", "d", "conv_id")
    at = cut(at.union(size.select("conv", F.lit(0).cast("long"), F.lit(top_id).cast(dict(size.dtypes)["conv"]))))
    above = lambda nodes, n: nodes.where(F.col("depth") >= n).withColumn("up", F.col("depth") - n).join(at.select(F.col("conv").alias("conv_id"), F.col("d").alias("up"), F.col("conv_id").alias("up_id")), ["conv_id", "up"])
    nodes = shared.select("conv_id", F.col("d").alias("depth"), "n_convs").join(t.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "chars"), ["conv_id", "depth"])
    nodes = above(nodes, 1).select("conv_id", "depth", F.col("up_id").alias("parent_conv_id"), "n_convs", "chars")
    nodes = cut(nodes.union(root.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast(dict(size.dtypes)["conv"]), "n_convs", F.lit(0).cast("long"))))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    sums = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    step = 1
    while step <= deepest:
        sent = above(sums, step).select(F.col("up_id").alias("conv_id"), F.col("up").alias("depth"), "n_leaves", "saved_tokens")
        sums = cut(sums.union(sent).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        step *= 2
    out = nodes.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = size.join(at.withColumnRenamed("d", "depth"), ["conv", "depth"]).select("conv", "conv_id", "depth")
    return out, ends
