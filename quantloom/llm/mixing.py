"""Mixing sources to target weights by pivotal dependent rounding.

A document is to be taken target / source size times. What that leaves of a
whole number is its fraction. Two documents of a source are paired and words
are moved between them, at random in direction but without bias, until one
fraction is 0 or 1; the words of the pair together stay the same, so a source
ends within one document of its target. Each task rounds a bounded share of a
source and leaves one fractional document; these residuals meet in the next
level of a reduction tree, until each source has one, which is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import boxed, cut, row_tag

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that are rounded one after another in a node of the tree.
FAN_IN = 4096
#: Range partitions over which sources are numbered.
RANGES = 64


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with place: 0 for the first by code point, null last."""
    ranged = cut(sources.repartitionByRange(RANGES, F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()))
    # a number for each range, not for each source
    counts = dict(ranged.groupBy("_part").count().collect())
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    if not before:
        return ranged.withColumn("place", F.lit(0)).drop("_part")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    inside = Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))
    return ranged.withColumn("place", F.row_number().over(inside) - 1 + base).drop("_part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. sizes: source, size.

    Sources, by code point and null last, have the weights in turn. Together
    they share `share` times all sizes by weight; a target stops at `most` times
    its source's size and the excess is shared again by weight, until none is
    above. Without sources, or if all sizes are 0, targets are 0 or absent.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod("place", F.lit(len(weights))) + 1
    src = _numbered(src).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    src = cut(src.withColumn("limit", F.lit(float(most)) * F.col("source_size")))
    total = float(src.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # each round fills at least one source more, all at once
        over = F.col("weight") * F.lit(level) >= F.col("limit")
        n, taken, free = src.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full:
            break
        full = n
        if free:
            level = max(level, (total - taken) / free)
    target = F.least(F.col("limit"), F.col("weight") * F.lit(level))
    return src.select("source", "source_size", target.alias("target"))


def _unit(*names: str):
    """A number in [0, 1) that depends on these columns."""
    return F.shiftrightunsigned(F.xxhash64(*names), 11) * F.lit(2.0**-53)


TINY = 1e-12
ROW = ["_id", "_tag", "source", "n_docs", "size", "fraction"]


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: each with its fraction rounded, but for one of each
    node that may stay fractional. Holds one row between batches."""
    node = held = schema = None
    for b in batches:
        schema = b.schema.remove(b.schema.get_field_index("_u"))
        out: list[dict] = []
        for r in b.to_pylist():
            u = r.pop("_u")
            if (r["source"], r["_bucket"]) != node:
                if held:
                    out.append(held)
                node, held = (r["source"], r["_bucket"]), r
                continue
            if held is None:
                held = r
                continue
            f0, f, size0, size = held["fraction"], r["fraction"], held["size"], r["size"]
            rest0, rest = (1 - f0) * size0, (1 - f) * size
            up, down = min(rest0, f * size), min(f0 * size0, rest)  # words that may move to the held row, and from it
            if u * (up + down) < down:
                t, first = up, up == rest0
            else:
                t, first = -down, down == f0 * size0
            held["fraction"], r["fraction"] = f0 + t / size0, f - t / size
            full, held = (held, r) if first else (r, held)
            full["fraction"] = float(round(full["fraction"]))
            out.append(full)
            if not TINY < held["fraction"] < 1 - TINY:
                held["fraction"] = float(round(held["fraction"]))
                out.append(held)
                held = None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist([held], schema)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: _id, _tag, source, size (words; null text: 0),
    source_size, target (the source's), copies (0 to `most`, rounded up).

    Depends on the rows alone, not on their order or partitions; rows equal in
    id and text may swap their copies. Rows of size 0 are never rounded: they
    get the whole part of the rate. Null ids and a null source (a source of its
    own) are allowed; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = cut(rows)
    t = targets(rows, weights, share, most).withColumnRenamed("source", "_source")
    n = rows.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_docs"))
    t = cut(t.join(n, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    whole = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = whole.withColumn("_base", F.floor(rate + TINY)).withColumn("fraction", rate - F.col("_base"))
    live = whole.where(f"size > 0 and fraction > {TINY}").select(*ROW)
    largest = t.agg(F.max("n_docs")).first()[0] or 0
    done, level, reach = [], 0, FAN_IN
    kinds = ", ".join(f"{k} {v}" for k, v in live.dtypes)
    while True:
        node = F.pmod(F.xxhash64("_id", "_tag", F.lit(level)), F.ceil(F.col("n_docs") / reach)).alias("_bucket")
        dealt = live.select(*ROW, node, _unit("_id", "_tag", F.lit(level + 1)).alias("_u")).repartition("source", "_bucket")
        dealt = dealt.sortWithinPartitions("source", "_bucket", F.desc("size"), "_u", "_id", "_tag")
        out = cut(dealt.mapInArrow(_rounded, kinds + ", _bucket long"))
        between = (F.col("fraction") > TINY) & (F.col("fraction") < 1 - TINY)
        done.append(out.where(~between).select(*ROW))
        live = out.where(between).select(*ROW)
        if reach >= largest:  # every source is one node by now
            break
        level, reach = level + 1, reach * FAN_IN
    drawn = live.withColumn("fraction", (_unit("_id", "_tag", F.lit(-1)) < F.col("fraction")).cast("double"))
    bits = reduce(DataFrame.union, [*done, drawn]).select("_id", "_tag", "source", "size", F.col("fraction").alias("_bit"))
    rest = whole.where(f"not (size > 0 and fraction > {TINY})").select("_id", "_tag", "source", "size", F.lit(0.0).alias("_bit"))
    both = bits.union(rest).join(t.drop("n_docs"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return both.select("_id", "_tag", "source", "size", "source_size", "target", (F.floor(rate + TINY) + F.col("_bit")).cast("int").alias("copies"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs (columns of any names) as often as the mix takes them, with
    copy_no (from 1; a column of docs of that name is replaced). Null and empty
    texts have no words and are taken as often as the whole part of the rate says."""
    docs = docs.drop("copy_no")
    m = mixed(docs, weights, share, most, id_col, text_col, source_col)
    m = m.groupBy(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), F.col("source").alias("_s")).agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    tagged = boxed(docs, F.col(id_col).alias("id"), row_tag(text_col).alias("tag"), F.col(source_col).alias("source"))
    both = tagged.join(m, F.col("id").eqNullSafe(F.col("_i")) & (F.col("tag") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")))
    alone = both.where(F.size("_copies") == 1).withColumn("_n", F.lit(1))
    same = Window.partitionBy("_i", "_t", "_s").orderBy(F.lit(0))
    equal = both.where(F.size("_copies") > 1).withColumn("_n", F.row_number().over(same))
    times = alone.union(equal).withColumn("_times", F.element_at("_copies", F.col("_n"))).where("_times > 0")
    return times.select("row.*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy_no"))
