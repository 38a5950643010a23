"""Secret scans: single-pattern findings, and weaker ones linked to each other.

Every pattern's matches are taken in one scan of the text each; where a match lies
follows from the lengths of the pieces between matches, added up by a window.
Weak candidates (account names, short or bare secrets, endpoints) are common in
clean text. They are reported only if a complementary part lies near them in
the same paragraph. That is an interval join of the parts of a document; as
only the nearest part of each class on either side matters, it is done as two
sorted sweeps (running maxima of ends, running minima of starts), linear in the
number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import boxed, repeated, row_tag

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short fail from each of their places, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts, each kind found by itself: an account's value may look like a secret's name, and a URL may hold a secret.
WEAK = {
    "account": r"""(?i)(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,64}""",
    "secret": (
        r"""(?i)(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,11}(?![A-Za-z0-9+/_.=-])"""
        # names that ASSIGN does not cover, so values of any length
        r"""|(?<![A-Za-z0-9])(?:pass|pwd|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
        r"""|(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"""
    ),
    "endpoint": r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?)://[^\s"'<>]+""",
}
PARAGRAPH = r"\n[\x20\t\r]*\n"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "account", "secret", "endpoint")
REACH = 400
#: Code points of a block when a text is put together anew: an array of single ones takes some 60 bytes for each.
BLOCK = 256


def _found(kind: str, matches: str, pieces: str, good: Column | None = None) -> Column:
    """An array of kind, i, before (code points since the last match), size."""
    return F.transform(
        matches,
        lambda m, i: F.struct(
            (F.lit(kind) if good is None else F.when(F.get(good, i), kind).otherwise("none")).alias("kind"),
            i.cast("int").alias("i"),
            F.char_length(F.get(F.col(pieces), i)).alias("before"),
            F.char_length(m).alias("size"),
        ),
    )


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _tag, kind, i, start, end, n: one row per match and distinct row of
    docs, and one of kind "row" whose n says how often that row is there."""
    df = docs.select(F.col(id_col).alias("_id"), row_tag(text_col).alias("_tag"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.withColumns({k: F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for k, p in {"a": ASSIGN, "k": ACCESS, "h": HEX, **WEAK}.items()})
    split = lambda p: F.split("_text", p, -1)
    some = lambda c: F.size(c) > 0
    weak = some("account") | some("secret") | some("endpoint")
    df = df.withColumns(
        {
            "ag": F.when(some("a"), F.transform(F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)),
            "ap": F.when(some("a"), split(ASSIGN)),
            "kp": F.when(some("k"), split(ACCESS)),
            "hp": F.when(some("h"), split(HEX)),
            **{f"{k}_p": F.when(some(k), split(p)) for k, p in WEAK.items()},
            "b": F.when(weak, F.regexp_extract_all("_text", F.lit(PARAGRAPH), F.lit(0))).otherwise(F.array().cast("array<string>")),
            "bp": F.when(weak, split(PARAGRAPH)),
        }
    )
    row = F.array(F.struct(F.lit("row").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("before"), F.lit(0).alias("size")))
    every = F.concat(row, _found("assign", "a", "ap", F.col("ag")), _found("access", "k", "kp"), _found("hex", "h", "hp"), *[_found(k, k, f"{k}_p") for k in WEAK], _found("paragraph", "b", "bp"))
    # each scan has a chain of lengths; only that of assignments has matches that fail
    chain = F.when(F.col("kind") == "none", "assign").otherwise(F.col("kind"))
    df = df.select("_id", "_tag", F.inline(every)).withColumn("chain", chain)
    df = df.groupBy("_id", "_tag", "chain", "i").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("before").alias("before"), F.max("size").alias("size"))
    along = Window.partitionBy("_id", "_tag", "chain").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.repartition("_id", "_tag").withColumn("end", F.sum(F.col("before") + F.col("size")).over(along))
    return df.where("kind != 'none'").select("_id", "_tag", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "n")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row of docs: id_col, n_assign, n_access, n_hex, spans (sorted array of
    start, ord, kind, end, covered; code points, end exclusive; ord is the
    kind's place in KINDS, covered the largest end of the spans before it).

    Null and empty texts have no spans. Rows may repeat and ids may be null:
    each row gets a result, equal rows equal ones. Other columns are ignored.
    """
    doc = ["_id", "_tag"]
    p = _parts(docs, id_col, text_col)
    order = [F.col("start"), F.col("end"), F.col("kind")]
    ahead = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("scope", F.sum((F.col("kind") == "paragraph").cast("int")).over(ahead)).where("kind != 'paragraph'")
    base = F.col("kind").isin(*BASE)
    part = {"a": F.col("kind").isin("access", "account"), "s": F.col("kind").isin("assign", "hex", "secret"), "e": F.col("kind") == "endpoint"}
    before = Window.partitionBy(*doc, "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*doc, "scope").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumns({f"{k}_end": F.max(F.when(c, F.col("end"))).over(before) for k, c in (part | {"b": base}).items()})
    p = p.withColumns({f"{k}_start": F.min(F.when(c, F.col("start"))).over(after) for k, c in (part | {"b": base}).items()})
    close = lambda gap: F.coalesce(gap <= reach, F.lit(False))
    near = {k: close(F.col("start") - F.col(f"{k}_end")) | close(F.col(f"{k}_start") - F.col("end")) for k in part}
    within_base = F.coalesce(F.col("b_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("b_start") < F.col("end"), F.lit(False))
    linked = ((F.col("kind") == "account") & near["s"]) | ((F.col("kind") == "secret") & near["a"]) | ((F.col("kind") == "endpoint") & near["a"] & near["s"])
    p = p.where((F.col("kind") == "row") | base | (linked & ~within_base))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    p = p.withColumn("ord", F.array_position(kinds, F.col("kind")).cast("int"))
    p = p.withColumn("covered", F.coalesce(F.max(F.when(F.col("kind") != "row", F.col("end"))).over(Window.partitionBy(*doc).orderBy("start", "ord", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    span = F.when(F.col("kind") != "row", F.struct("start", "ord", "kind", "end", "covered"))
    out = p.groupBy(*doc).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list(span)).alias("spans"), F.max(F.when(F.col("kind") == "row", F.col("n"))).alias("_times"))
    return repeated(out.withColumnRenamed("_id", id_col), "_times")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _between(blocks: str, start: Column, n: Column) -> Column:
    """n code points from start (counted from 0) of a text in blocks of BLOCK: only the blocks that hold them are opened."""
    whole = lambda c: F.floor(c / BLOCK).cast("int")
    some = F.slice(blocks, whole(start) + 1, whole(start + n + BLOCK - 1) - whole(start))
    return F.substring(F.array_join(some, ""), (start % BLOCK + 1).cast("int"), n.cast("int"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, reach: int = REACH) -> DataFrame:
    """docs (columns of any names) with each stretch of secrets replaced by its first
    kind in brackets; size_col, if given, becomes the new length in code points.
    Null and empty texts stay as they are, and repeated rows are changed alike."""
    found = secret_spans(docs, id_col, text_col, reach).where(F.size("spans") > 0).select(F.col(id_col).alias("found_id"), F.col("_tag").alias("found_tag"), "spans").dropDuplicates(["found_id", "found_tag"])
    tagged = boxed(docs, F.col(id_col).alias("id"), row_tag(text_col).alias("tag"))  # the text goes along once, in row
    both = tagged.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left")
    both = both.withColumn("text", F.col(f"row.`{text_col}`"))
    both = both.withColumn("_blocks", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    firsts = F.filter("spans", lambda s: s["start"] >= s["covered"])
    head = F.array_join(F.transform(firsts, lambda s: F.concat(_between("_blocks", s["covered"], s["start"] - s["covered"]), F.lit("["), s["kind"], F.lit("]"))), "")
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    both = both.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(head, _between("_blocks", last, F.char_length("text") - last))))
    new = {text_col: F.col("text")} | ({size_col: F.char_length("text").cast(docs.schema[size_col].dataType)} if size_col else {})
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
