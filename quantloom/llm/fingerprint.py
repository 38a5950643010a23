"""Canonical exact digests of texts, grouped with byte comparison.

The canonical form is composed (Unicode NFC), has its case folded, and each run
of whitespace folded to one space and none at its ends. Its fingerprint is two
xxhash64 values of different seeds. Texts whose fingerprints are equal are
compared byte by byte (the least and the greatest canonical form of a bucket
are equal exactly if all are); in a bucket that holds different forms the
SHA-256 of the form tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quantloom.llm.common import boxed, cut, repeated, row_tag

SPACE = r"[\s\x1C-\x1F\u0085   -     　]+"
#: Ids that share this quotient are neighbours in one window group.
BUCKET = 1024


def folded(text: Column) -> Column:
    """NFC, with case folded (ß is ss, both sigmas are one), and NFC again, by the ICU
    library that Spark itself ships for collations. Plain ASCII texts, for which
    lower case is all of it, are not handed over."""
    nfc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), nfc(fold(nfc(text)))).otherwise(F.lower(text))


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), SPACE, " "))


def digest(form: Column) -> Column:
    """32 hex digits."""
    part = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    return F.concat(part(form), part(F.lit(1), form))


def _digested(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the digest of a column's canonical form, which is made once; a column of that name is replaced."""
    own = [F.col(f"row.`{c}`") for c in df.columns if c != name]
    return boxed(df, canonical(F.col(text)).alias("form")).select(*own, digest(F.col("form")).alias(name))


def colliding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fp of the buckets whose canonical forms are not all equal.

    Only rows in buckets of two or more are compared, and each task brings no
    more than a least and a greatest form of a bucket, so a bucket with a third
    of all rows is no larger to merge than any other.
    """
    df = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    fps = cut(_digested(df, "_text", "fp").select("_id", "_tag", "fp"))
    several = fps.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    at = fps.join(several, "fp", "left_semi").groupBy("_tag").agg(F.min("fp").alias("fp"))
    forms = df.join(at, "_tag").select("fp", canonical(F.col("_text")).alias("form"))
    return forms.groupBy("fp").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least != most").select("fp")


def _resolved(df: DataFrame, clash: DataFrame, count: int, fp: str, form: Column) -> DataFrame:
    """fp with the digest of the form added where its bucket holds several forms."""
    if not count:
        return df
    # how it is joined is left to Spark, which knows the written table's size
    wide = boxed(df, F.col(fp).alias("fp"), form.alias("form")).join(clash.select(F.col("fp").alias("clash")), F.col("fp") == F.col("clash"), "left")
    told = F.when(F.col("clash").isNull(), F.col("fp")).otherwise(F.concat("fp", F.lit("-"), F.sha2(F.encode("form", "UTF-8"), 256)))
    return wide.select(*[told.alias(c) if c == fp else F.col(f"row.`{c}`") for c in df.columns])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clash: DataFrame | None = None) -> DataFrame:
    """docs with a column fingerprint. Equal canonical forms, and no others, have
    equal fingerprints. Null counts as the empty text; rows and ids may repeat
    or be null; a column of docs named fingerprint is replaced."""
    clash = cut(colliding(docs, id_col, text_col)) if clash is None else clash
    form = canonical(F.col(text_col))
    return _resolved(_digested(docs, text_col, "fingerprint"), clash, clash.count(), "fingerprint", form)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, first_id (smallest), copies: one row per canonical form."""
    return fingerprints(docs, id_col, text_col).groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def _after(keys: DataFrame, order: list[Column]) -> DataFrame:
    """keys (narrow, any number of rows) with `next`: the struct of the row that
    follows in the order, after the last the first."""
    cols = keys.columns
    me = F.struct(*cols)
    ranged = cut(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    here = ranged.withColumn("next", F.lead(me).over(inside)).withColumn("_n", F.row_number().over(inside))
    # one row per range partition
    firsts = here.where("_n = 1").select("_part", me.alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_part")
    turn = firsts.select("_part", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("turn"))
    return here.join(turn, "_part").select(*cols, F.coalesce("next", "turn").alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, text, next_text, edited: the text whose last
    floor(n / 2) code points are replaced by the first as many of the next row.

    Rows follow each other by descending id (null last), then by descending
    hash of the text; the first follows the last. Null texts count as empty.
    With whole numbers as ids texts move in one shuffle by ranges of ids, and
    only the last row of each range is looked up separately; with ids of other
    kinds, rows are linked first and texts join the links.
    """
    df = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.coalesce(text_col, F.lit("")).alias("_text"))
    both = _by_ranges(df) if isinstance(docs.schema[id_col].dataType, IntegralType) else _by_links(df)
    half = F.floor(F.char_length("_text") / 2).cast("int")
    cut_in = F.concat(F.substring("_text", F.lit(1), F.char_length("_text") - half), F.substring("_next", F.lit(1), half))
    return both.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), F.col("_next").alias("next_text"), cut_in.alias("edited"))


def _by_links(df: DataFrame) -> DataFrame:
    """_id, _text, _next. Equal rows follow each other, the last of them has the next row's text."""
    keys = df.groupBy("_id", "_tag").agg(F.count("*").alias("_times"))
    links = _after(keys, [F.desc_nulls_last("_id"), F.desc("_tag")])
    texts = cut(df.groupBy("_id", "_tag").agg(F.first("_text").alias("_text")))
    mine = links.join(texts.toDF("_i", "_t", "_text"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t"))).drop("_i", "_t")
    both = mine.join(texts.toDF("_i", "_t", "_next"), F.col("next._id").eqNullSafe(F.col("_i")) & (F.col("next._tag") == F.col("_t")))
    again = repeated(both.where("_times > 1").select("_id", "_text", F.col("_text").alias("_next"), (F.col("_times") - 1).alias("_times")), "_times")
    return both.select("_id", "_text", "_next").union(again)


def _by_ranges(df: DataFrame) -> DataFrame:
    """_id, _text, _next, for whole numbers as ids."""
    key = F.floor(F.col("_id") / BUCKET).cast("long")
    # rows without an id are dealt by the first bits of their hash, which continues the order: about BUCKET to a group
    several = df.where("_id is null").count() // BUCKET
    sub = F.when(F.col("_id").isNull(), F.shiftright("_tag", 64 - min(several.bit_length(), 40))).otherwise(0) if several else F.lit(0)
    df = df.withColumn("_key", key).withColumn("_sub", sub)
    down = [F.desc_nulls_last("_id"), F.desc("_tag")]
    w = Window.partitionBy("_key", "_sub").orderBy(*down)
    inner = df.withColumn("_next", F.lead("_text").over(w)).where(F.col("_next").isNotNull()).select("_id", "_text", "_next")
    ends = df.groupBy("_key", "_sub").agg(F.min(F.struct("_id", "_tag")).alias("last"), F.max(F.struct("_id", "_tag")).alias("first"))
    ends = cut(_after(ends, [F.desc_nulls_last("_key"), F.desc("_sub")]))
    wanted = ends.select("_key", "_sub", F.inline(F.array(F.struct(F.lit(0).alias("_part"), "last._id", "last._tag"), F.struct(F.lit(1).alias("_part"), "next.first._id", "next.first._tag"))))
    wanted = wanted.select(F.col("_key").alias("_k"), F.col("_sub").alias("_s"), "_part", F.col("_id").alias("_i"), F.col("_tag").alias("_t"))
    got = df.select("_id", "_tag", "_text").join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t")))
    got = got.groupBy("_k", "_s").agg(F.max(F.when(F.col("_part") == 0, F.struct("_id", "_text"))).alias("me"), F.max(F.when(F.col("_part") == 1, F.col("_text"))).alias("_next"))
    return inner.union(got.select("me._id", "me._text", "_next"))


def comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edited() with fingerprint, next_fingerprint, edited_fingerprint, near_next
    and near_edited: 1.0 where fingerprints, and then bytes, are equal, else 0.0."""
    clash = cut(colliding(docs, id_col, text_col))
    n = clash.count()
    df = edited(docs, id_col, text_col)
    names = {"fingerprint": "text", "next_fingerprint": "next_text", "edited_fingerprint": "edited"}
    for fp, text in names.items():
        df = _resolved(_digested(df, text, fp), clash, n, fp, canonical(F.col(text)))
    same = lambda fp, text: F.when(F.col("fingerprint") != F.col(fp), 0.0).when(canonical(F.col("text")) == canonical(F.col(text)), 1.0).otherwise(0.0)
    return df.withColumns({"near_edited": same("edited_fingerprint", "edited"), "near_next": same("next_fingerprint", "next_text")})
