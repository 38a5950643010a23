"""Benchmark decontamination as a prefix-filtered containment join.

The tokens of a benchmark window (some consecutive words of an item) are its
shingles of five words, or the whole window if it is shorter. A window is
contained in a document only if all n tokens are: of a containment of 1, the
necessary prefix is n - n + 1 = 1 token, and the one that is rarest over all
documents gives the fewest candidates. Documents' shingles meet the prefix
tokens in a broadcast hash join; a candidate must have room for the whole
window around the place of its prefix token, and then its words are compared
with the window's. The prefixes are broadcast in blocks of a bounded size: a
larger benchmark takes more passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower, boxed, cut, repeated, row_tag

#: What lies between words. A-Z still count as word characters here, since lower-casing comes after.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a token; windows of fewer words are tokens themselves.
SHINGLE = 5
BLOCK_BYTES = 16 << 20
#: What a window takes in a broadcast table besides its text.
ROW_BYTES = 120


def _words(c: Column) -> Column:
    """The words of a text after a first and before a last element that are none."""
    return F.split(F.concat(F.lit("x "), F.coalesce(c, F.lit("")), F.lit(" x")), BETWEEN, -1)


def _hashed(words: str) -> Column:
    """Hashes of words, equal for those that differ in A-Z and a-z only (and for some others)."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _tokens(hashes: str, sizes: list[int], n: Column, skip: int) -> Column:
    """An array of (off, token): the shingles of each of these sizes of the n hashes
    after the first `skip`, off being their place in the array."""
    token = lambda i, k: F.xxhash64(F.lit(k), *[F.get(F.col(hashes), i + j) for j in range(k)])
    none = F.array().cast("array<struct<off:int,token:bigint>>")
    each = lambda k: F.transform(F.sequence(F.lit(skip), n - k + skip), lambda i: F.struct(i.cast("int").alias("off"), token(i, k).alias("token")))
    return F.concat(none, *[F.when(n >= k, each(k)).otherwise(none) for k in sizes])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """One row per item and distinct window: item, n (words), words, seq (the words space-joined)."""
    split = items.select(F.col(id_col).cast("string").alias("item"), _words(ascii_lower(F.col(text_col))).alias("all"))
    split = split.withColumn("all", F.slice("all", F.lit(2), F.size("all") - 2))
    n = F.least(F.lit(width), F.size("all"))
    at = split.where(F.size("all") > 0).select("item", n.alias("n"), "all", F.explode(F.sequence(F.lit(1), F.size("all") - n + 1)).alias("i"))
    win = at.select("item", "n", F.expr("slice(all, i, n)").alias("words"))
    return win.withColumn("seq", F.array_join("words", " ")).dropDuplicates(["item", "seq"])


def _rarest(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with token, off: their rarest token over all documents and its first place (from 0)."""
    hashed = windows.select("item", "seq", "n", _hashed("words").alias("h"))
    size = F.least(F.col("n"), F.lit(SHINGLE))
    own = reduce(DataFrame.union, [hashed.where(size == k).select("item", "seq", F.inline(_tokens("h", [k], F.col("n"), 0))) for k in range(1, SHINGLE + 1)])
    used = cut(own)
    vocabulary = used.select("token").distinct()
    said = docs.select(F.explode(F.transform("_tokens", lambda t: t["token"])).alias("token"))
    counts = said.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("df"))
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off")
    best = used.join(counts, "token", "left").groupBy("item", F.col("seq").alias("_seq")).agg(F.min(order).alias("best")).withColumnRenamed("item", "_item")
    both = windows.join(best, (F.col("seq") == F.col("_seq")) & F.col("item").eqNullSafe(F.col("_item")))
    return both.select("item", "n", "seq", "best.token", "best.off")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, item_ids (sorted array), spans
    (array of start, end in words, end exclusive), contaminated.

    A null or empty text has no words and no hits. Rows may repeat and ids may
    be null: each row gets a result, equal rows equal ones. An item without
    words has no windows; repeated items count once; windows of an item whose
    id is null hit words but the item is not listed. Other columns are ignored.
    """
    windows = cut(item_windows(items, item_id, item_text, width))
    sizes = sorted(r[0] for r in windows.select(F.least(F.col("n"), F.lit(SHINGLE))).distinct().collect())  # SHINGLE at most
    docs = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), _words(F.col(text_col)).alias("_words"))
    docs = docs.withColumn("_hashes", _hashed("_words")).withColumn("_tokens", _tokens("_hashes", sizes, F.size("_words") - 2, 1)).drop("_hashes")
    total = windows.agg(F.sum(F.octet_length("seq") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    parts = []
    for k in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("item", "seq"), F.lit(blocks)) == k) if blocks > 1 else windows
        prefixes = cut(_rarest(docs, mine)).withColumnRenamed("token", "_token")
        # place 0 stands for the row itself
        row = F.array(F.struct(F.lit(0).alias("off"), F.lit(None).cast("bigint").alias("token")))
        at = docs.select("_id", "_tag", "_words", F.inline(F.concat(row, F.col("_tokens"))).alias("_pos", "_t"))
        start = F.col("_pos") - F.col("off")
        held = (F.col("_t") == F.col("_token")) & (start >= 1) & (start + F.col("n") < F.size("_words")) & (ascii_lower(F.array_join(F.slice("_words", start + 1, F.col("n")), " ")) == F.col("seq"))
        met = at.join(F.broadcast(prefixes), held, "left").where((F.col("_pos") == 0) | F.col("seq").isNotNull())
        span = F.when(F.col("seq").isNotNull(), F.struct((start - 1).alias("start"), (start - 1 + F.col("n")).alias("end")))
        parts.append(met.select("_id", "_tag", (F.size("_words") - 2).alias("n_words"), ((F.col("_pos") == 0) & F.lit(k == 0)).cast("long").alias("_row"), span.alias("span"), "item"))
    rows = reduce(DataFrame.union, parts).groupBy("_id", "_tag").agg(F.max("n_words").cast("long").alias("n_words"), F.sum("_row").alias("_times"), F.array_sort(F.collect_set("span")).alias("_spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    # spans that touch or overlap become one; their lengths add up to the words hit
    cover = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("n")),
    )["n"]
    out = rows.select(F.col("_id").alias(id_col), "n_words", cover.alias("n_hit"), "item_ids", F.col("_spans").alias("spans"), "_times", "_tag").withColumn("contaminated", F.col("n_hit") > 0)
    return repeated(out, "_times")


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns (of any names), in which no window of an
    item occurs. Null and empty texts stay, and repeated rows stay or go together."""
    found = contamination(docs, items, width, id_col, text_col).where("contaminated").select(F.col(id_col).alias("bad"), F.col("_tag").alias("bad_tag")).distinct()
    tagged = boxed(docs, F.col(id_col).alias("id"), row_tag(text_col).alias("tag"))
    return tagged.join(found, F.col("id").eqNullSafe(F.col("bad")) & (F.col("tag") == F.col("bad_tag")), "left_anti").select("row.*")
