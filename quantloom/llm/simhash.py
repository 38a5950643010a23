"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that differ
in at most two bits, one segment differs in at most one, so with that bit
masked out (a one-wildcard variant) the segments are equal. The index holds,
for each distinct fingerprint, both segments with each of their bits masked.
Variants held by two fingerprints give one candidate pair, which is verified.
Variants held by more would give all pairs of a group; the fingerprints in them
are linked through the 65 values at no more than one bit's distance instead:
two fingerprints differ in at most two bits exactly if such a value is common
to both, so a star around each value links the same groups.

Two bits reach texts that are nearly equal. For a likeness of 0.8 the sets of
shingles are joined: two sets that are so alike share one of the rarest
n - ceil(0.8 n) + 1 shingles of either (in any order common to all), so these
are the keys under which texts meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, boxed, cut, row_tag
from quantloom.llm.components import components

SEED = 42
CHUNK = 1 << 16


#: Counters of the table that orders shingles (some hold several of them), and those that travel in one row.
COUNTERS, SLICE = 1 << 20, 1 << 10
#: Longs in which a set is outlined, and holders of a key that one task pairs with as many others.
OUTLINE, BLOCK = 4, 1024
#: Parts, at most, in which pairs meet their texts: only one part's texts are on disk at a time. Each part
#: deals all texts, so there are fewer where the texts of the pairs are less than all texts.
PARTS = 4
#: Room for rounding in bounds; what they let through is compared exactly.
SLACK = 1e-6


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text; of all its words, if they are fewer."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, n)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of hashed shingles; 0 without any."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += _bits(h[at : at + CHUNK]).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def counters(docs: DataFrame, width: int, text_col: str = "text") -> Broadcast:
    """How many texts hold a shingle of each of COUNTERS hash values, over all texts.
    The size is the same for any corpus. The counts only order shingles, so that
    two share a counter changes no result."""
    slices = COUNTERS // SLICE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int32)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, _counter(np.unique(shingles(t.as_py(), width))), 1)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in n.reshape(slices, SLICE)])], ["slice", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_py(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "n"])

    found = docs.select(text_col).mapInArrow(each, "slice int, n binary").repartition("slice").mapInArrow(added, "slice int, n binary")
    n = np.zeros((slices, SLICE), np.int64)
    for k, x in found.collect():  # one row a slice
        n[k] = np.frombuffer(x, np.int64)
    return docs.sparkSession.sparkContext.broadcast(n.reshape(-1))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def rarest(h: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Of a set (sorted), the rarest shingles, one of which is in each set that is alike by `least`."""
    return h[np.lexsort((h, counts[_counter(h)]))][: len(h) - math.ceil(least * len(h) - SLACK) + 1]


def outline(h: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of a set's members hash to them. Sets
    differ in at least as many members as their outlines in bits."""
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % (64 * OUTLINE), minlength=64 * OUTLINE) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """_id, _tag, fp per row of docs; with least, also of the set of shingles: s (128 bits that stand for it), n (size), keys (rarest), o0, ... (outline)."""
    source = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    counts = counters(docs, width, text_col) if least is not None else None
    more = {} if least is None else {"s": "binary", "n": "int", "keys": "array<long>"} | {f"o{i}": "long" for i in range(OUTLINE)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets, keys, lines = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), width)
                fps.append(fingerprint(h))
                if least is not None:
                    h = np.unique(h)
                    sets.append((xxhash.xxh128_digest(h.tobytes(), SEED), len(h)))
                    keys.append(rarest(h, counts.value, least).view(np.int64) if len(h) else [])
                    lines.append(outline(h))
            extra = []
            if least is not None:
                extra = [pa.array([x[0] for x in sets], pa.binary()), pa.array([x[1] for x in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                extra += [pa.array([x[i] for x in lines], pa.int64()) for i in range(OUTLINE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), *extra], ["_id", "_tag", "fp", *more])

    kind = dict(source.dtypes)["_id"]
    return source.mapInArrow(each, ", ".join([f"_id {kind}, _tag long, fp long", *(f"{k} {v}" for k, v in more.items())]))


PAIR = ["xs", "xf", "ys", "yf"]


def _apart() -> Column:
    """Members in which the sets x and y differ, at least."""
    return sum((F.bit_count(F.col(f"x.o{i}").bitwiseXOR(F.col(f"y.o{i}"))) for i in range(OUTLINE)), F.lit(0))


def _may(least: float) -> Column:
    """Whether x and y, of which this is the first key in common, may be alike."""
    both = (F.col("x.n") + F.col("y.n")).cast("double")
    need = both * (least / (1 + least)) - SLACK
    return (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need) & (_apart() <= both - need * 2)


def _holders(keyed: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """key, y (set, fp, n, pos: place of the key in the set's order, outline) for the keys
    that several sets hold. keyed: s, keys. Keys meet with no more than their set's number."""
    keyed = keyed.select("s", F.posexplode("keys").alias("pos", "key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    lines = [f"o{i}" for i in range(OUTLINE)]
    return scratch.cut(keyed.join(shared, "key").join(one.select("s", "fp", "n", *lines), "s").select("key", F.struct("s", "fp", "n", "pos", *lines).alias("y")))


def _stars(held: DataFrame, least: float) -> DataFrame:
    """Pairs of the sets of a key with one of them: one that has few shingles rarer
    than the key, as the original of a family of copies."""
    centre = F.min(F.struct("y.pos", F.xxhash64("y.s").alias("h"), "y"))
    met = held.join(held.groupBy("key").agg(centre.alias("c")).select("key", F.col("c.y").alias("x")), "key").where("x.fp != y.fp").where(_may(least))
    return met.select(F.col("x.s").alias("xs"), F.col("x.fp").alias("xf"), F.col("y.s").alias("ys"), F.col("y.fp").alias("yf")).distinct()


def _rooted(df: DataFrame, edges: DataFrame, **cols: str) -> DataFrame:
    """df with the roots, by name, of the fingerprints in the columns given."""
    roots = cut(components(edges))
    for name, c in cols.items():
        df = df.withColumn("_node", F.col(c)).join(roots.select(F.col("node").alias("_node"), F.col("root").alias(name)), "_node", "left")
        df = df.withColumn(name, F.coalesce(name, "_node")).drop("_node")
    return df


def _across(held: DataFrame, edges: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """All pairs of sets that have a key in common, may be alike and aren't connected
    by edges, with the roots xr and yr and apart.

    Of a key's holders most are often connected already: those of its largest
    component meet the others, and the others each other, each side in blocks,
    so no task gets all pairs of a key and the largest component's sets are sent
    as often as there are blocks of others.
    """
    own = _rooted(held, edges, r="y.fp")
    by_root = own.groupBy("key", "r").agg(F.count("*").alias("k"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    open_ = by_root.groupBy("key").agg(F.max_by("r", F.struct("k", "r")).alias("most"), F.max("k").alias("g"), F.sum("k").alias("k"), F.count("*").alias("roots")).where("roots > 1")
    open_ = open_.select("key", "most", blocks(F.col("g")).alias("gs"), blocks(F.col("k") - F.col("g")).alias("os"))
    live = scratch.cut(own.join(open_, "key").select("key", "y", "r", (F.col("r") == F.col("most")).alias("in_most"), "gs", "os"))
    place = lambda n: F.pmod(F.xxhash64("y.s"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    largest, others = live.where("in_most"), live.where("not in_most")
    x = largest.select("key", F.col("y").alias("x"), F.col("r").alias("xr"), place("gs").alias("i"), every("os").alias("j"))
    y = others.select("key", "y", F.col("r").alias("yr"), place("os").alias("j"), every("gs").alias("i"))
    left = others.select("key", F.col("y").alias("x"), F.col("r").alias("xr"), place("os").alias("i"), every("os").alias("j"))
    right = others.select("key", "y", F.col("r").alias("yr"), place("os").alias("j"), every("os").alias("i"))
    pairs = None
    for a, b, ok in ((x, y, F.lit(True)), (left, right, F.col("xr") < F.col("yr"))):
        ends = [F.struct(F.col(f"{v}r").alias("r"), F.col(f"{v}.s").alias("s"), F.col(f"{v}.fp").alias("f")) for v in "xy"]
        met = a.join(b, ["key", "i", "j"]).where(ok & _may(least)).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), _apart().alias("apart"))
        pairs = met if pairs is None else pairs.union(met)
    return pairs.select(F.col("a.s").alias("xs"), F.col("a.f").alias("xf"), F.col("b.s").alias("ys"), F.col("b.f").alias("yf"), F.col("a.r").alias("xr"), F.col("b.r").alias("yr"), "apart").distinct()


def _alike(docs: DataFrame, met: DataFrame, one: DataFrame, width: int, least: float, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The pairs of met (PAIR) whose sets of shingles have a Jaccard likeness of
    `least` or more. one: the row (_i, _t) that stands for each s."""
    met = scratch.cut(met)
    # texts of the documents in question only
    asked = one.join(met.select(F.col("xs").alias("s")).union(met.select("ys")).distinct(), "s").select("s", "_i", "_t")
    rows = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    texts = scratch.cut(rows.join(asked, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t"))).groupBy("s").agg(F.first("_text").alias("text")))
    pairs = met.join(texts.select(F.col("s").alias("xs"), F.col("text").alias("tx")), "xs").join(texts.select(F.col("s").alias("ys"), F.col("text").alias("ty")), "ys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for s, t in zip(b.column("tx"), b.column("ty"), strict=True):
                u, v = (np.unique(shingles(c.as_py(), width)) for c in (s, t))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= least * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("xf"), b.column("yf")], ["a", "b"]).filter(pa.array(good))

    return pairs.select("xf", "yf", "tx", "ty").mapInArrow(compare, "a long, b long")


def similar(docs: DataFrame, fps: DataFrame, edges: DataFrame, width: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: edges, and further ones that connect all fingerprints of documents
    that are alike by `least`. fps: fingerprints(least=least). What earlier edges
    connect isn't compared again: stars come first, then the nearest pair of each
    two components, then every pair that is left."""
    spark = docs.sparkSession
    keys = Scratch(spark)
    # each set once, under a number
    row = F.min(F.struct("fp", "_id", "_tag", "n", *[f"o{i}" for i in range(OUTLINE)])).alias("r")
    sets = fps.where("n > 0").groupBy("s").agg(row, F.first("keys").alias("keys")).withColumnRenamed("s", "digest")
    keyed = keys.cut(sets.select(F.monotonically_increasing_id().alias("s"), "digest", "r.*", "keys").withColumnsRenamed({"_id": "_i", "_tag": "_t"}))
    one = cut(keyed.drop("keys", "digest"))
    # words that repeat count in a fingerprint and not in a set
    same = fps.select(F.col("s").alias("digest"), F.col("fp").alias("b")).join(keyed.select("digest", F.col("fp").alias("a")), "digest").where("a != b").select("a", "b").distinct()
    edges = cut(edges.union(same))

    size = F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))
    whole = one.agg(size).first()[0]

    def alike(edges: DataFrame, met: DataFrame) -> DataFrame:
        met = cut(met)
        carried = met.select(F.explode(F.array("xs", "ys")).alias("s")).join(one.select("s", "n"), "s").agg(size).first()[0]
        parts = min(PARTS, math.ceil(PARTS * carried / max(whole, 1)))
        for k in range(parts):  # pairs carry two texts: a part of them at a time
            step = Scratch(spark)
            mine = met.where(F.pmod(F.xxhash64("xs", "ys"), F.lit(parts)) == k)
            edges = cut(edges.union(_alike(docs, mine, one, width, least, id_col, text_col, step)))
            step.clear()
        return edges

    held = _holders(keyed, one, keys)
    edges = alike(edges, _rooted(_stars(held, least), edges, xr="xf", yr="yf").where("xr <> yr").select(*PAIR))
    left = cut(_across(held, edges, least, keys))
    del held
    keys.clear()
    if left.isEmpty():
        return edges
    nearest = cut(left.groupBy("xr", "yr").agg(F.min(F.struct("apart", *PAIR)).alias("p")).select("p.*").select(*PAIR))
    edges = alike(edges, nearest)
    left = left.select(*PAIR).join(nearest.select("xs", "ys"), ["xs", "ys"], "left_anti")
    return alike(edges, _rooted(left, edges, xr="xf", yr="yf").where("xr <> yr").select(*PAIR))


def _variants(fps: DataFrame) -> DataFrame:
    """fp, key: both halves of fp, each with one of its bits masked out; the key
    holds the half and tells which one and which bit."""
    bit = F.col("seg")
    half = F.when(bit < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    mask = F.expr("~shiftleft(1L, seg % 32)")
    key = half.bitwiseAND(mask) + bit.cast("long") * (1 << 32)
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("seg")).select("fp", key.alias("key"))


def links(fps: DataFrame, within: int = 2) -> DataFrame:
    """a, b: edges that connect the same fingerprints as the pairs of distinct
    values (column fp, no repeats) that differ in at most two bits."""
    if within != 2:
        raise ValueError("two segments and one wildcard are for two bits")
    v = _variants(fps).repartition("key")  # dealt once, for the groups and for their members
    held = v.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    held = cut(v.join(held, "key").select("fp", "n", "a", "b"))
    pairs = held.where("n = 2 and fp = a").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= within).select("a", "b").distinct()
    crowded = held.where("n > 2").select("fp").distinct()
    near = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    near = near.select("fp", F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("value")).repartition("value")
    hubs = near.groupBy("value").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1").select("value", "a")
    stars = near.join(hubs, "value").where("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """Per row of docs: id_col, fingerprint (16 hex digits), component_id (the
    smallest id that a chain of links reaches), _tag.

    Fingerprints within two bits link. With `least`, so do all documents whose
    sets of shingles are alike by that much: two bits of 64 hold for nearly
    equal texts only. A text without words (null too) has
    fingerprint zero and links like any other. Rows whose id is null are
    linked, but no component is named by them unless all its ids are null.
    Repeated rows get a result each.
    """
    fps = cut(fingerprints(docs, width, id_col, text_col, least))
    first = cut(fps.groupBy("fp").agg(F.min("_id").alias("least")))
    edges = links(first.select("fp"))
    if least is not None:
        edges = similar(docs, fps, cut(edges), width, least, id_col, text_col)
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    home = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    name = home.groupBy("root").agg(F.min("least").alias("component_id"))
    of = home.join(name, "root").select("fp", "component_id", "root")
    out = fps.select("_id", "_tag", "fp").join(of, "fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_tag", F.col("root").alias("_root"))


def deduplicated(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float | None = 0.8) -> DataFrame:
    """One row of each component, with the columns of docs (of any names): one whose
    id names the component. Where no row of a component has an id, one of them
    stays. Texts without words (null ones too) are one component."""
    comp = near_duplicates(docs, width, id_col, text_col, least)
    named = comp.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = named.groupBy("_root").agg(F.min(F.struct("_tag", F.col(id_col).alias("_keep"))).alias("k")).select("k._keep", "k._tag")
    keep = cut(keep)
    tagged = boxed(docs, F.col(id_col).alias("id"), row_tag(text_col).alias("tag"))
    kept = tagged.join(keep, F.col("id").eqNullSafe(F.col("_keep")) & (F.col("tag") == F.col("_tag")), "left_semi")
    again = named.join(keep, named[id_col].eqNullSafe(keep["_keep"]) & (named["_tag"] == keep["_tag"])).groupBy("_keep", keep["_tag"]).count().where("count > 1")
    if not again.isEmpty():  # equal rows under one id: a shuffle of texts that few tables need
        kept = kept.dropDuplicates(["id", "tag"])
    return kept.select("row.*")
