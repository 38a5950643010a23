"""Substring dedup as a relative Lempel-Ziv parse.

Each document is factored against the documents with smaller ids. Windows of
`width` words are the seeds; their index is dealt over the cluster in blocks by
hash, and the block that owns a window names the first document that has it.

1. Anchors, the windows where a text is cut by its own words, ask first. Around
   each answer, the words of both documents are compared along the diagonal
   that the two places give, and every run of equal words of a window's length
   or more is a factor, however far it reaches.
2. At the ends of factors, and where no anchor was answered, single windows are
   checked: those that lie in no factor and whose rarest part (the least hash of
   the short word runs in a window) is in several documents ask in the same way.

Reference texts stay in one place each: the stretches that ask are sent to
them, and a document that very many ask is laid out in several copies. A
window's first holder has it in no factor, so windows left out of step 2 never
hide an earlier holder. Hashes only find candidates (two windows with the same
128 bits count as one candidate); what is removed has been compared as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import cut, row_tag

WIDTH = 13
#: Words of a short run; a window holds WIDTH - RUN + 1 of them.
RUN = 5
#: Mean length of a chunk in words.
CHUNK = 32
#: Words whose hashes a task remembers.
MEMORY = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text that are parsed at a time (a longer text by itself).
SLICE = 1 << 21
#: Words on either side of its answered places that a document sends to a reference text.
REACH = 256
#: Asks that one copy of a reference text answers.
ASKS = 1024


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """Powers of an odd number modulo 2^64, as many as any text has asked for."""

    def __init__(self, base: int):
        self.base, self.all = np.uint64(base), np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.all):
            p = np.full(max(n, 2 * len(self.all)), self.base)
            p[0] = 1
            self.all = np.multiply.accumulate(p)
        return self.all[:n]


UP = [_Powers(b) for b in BASES]
DOWN = [_Powers(pow(b, -1, 1 << 64)) for b in BASES]


class Slice:
    """Some texts parsed side by side. Places count over the words of all."""

    known = _Words()

    def __init__(self, texts: list[str], width: int = WIDTH):
        self.width, self.words = width, [t.encode().split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.off = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(self.words)), np.uint64, total)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        place = np.arange(total) - self.off[self.doc]
        #: Whether a window begins here, and whether it is a text's first.
        self.valid = place + width <= self.n[self.doc]
        self.head = self.valid & (place == 0)
        self.sums: dict[int, np.ndarray] = {}

    def hashed(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The k-th hash of each stretch of words [start, end): sums of words times
        powers, by differences of running sums, brought back to the power 0."""
        if k not in self.sums:
            s = self.sums[k] = np.zeros(len(self.h) + 1, np.uint64)
            np.cumsum((self.h ^ (self.h >> np.uint64(31 + k))) * UP[k].first(len(self.h)), out=s[1:])
        s = self.sums[k]
        v = (s[end] - s[start]) * DOWN[k].first(len(s))[start] + (end - start).astype(np.uint64) * MIX
        v ^= v >> np.uint64(32)
        v *= MIX
        return (v ^ (v >> np.uint64(29))).view(np.int64)

    def runs(self) -> np.ndarray:
        """A hash for each short run of words."""
        at = np.arange(max(0, len(self.h) - RUN + 1))
        return self.hashed(0, at, at + RUN).view(np.uint64)

    def rarest(self, runs: np.ndarray) -> np.ndarray:
        """For each place the least hash of the runs of its window (any number where there is none)."""
        out = np.full(len(self.h), np.iinfo(np.uint64).max)
        for j in range(self.width - RUN + 1):
            part = runs[j:]
            np.minimum(out[: len(part)], part, out=out[: len(part)])
        return out.view(np.int64)

    def chunks(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) window of each chunk: they part where a run's hash
        says so, so equal stretches are parted alike."""
        cut_here = self.head.copy()
        cut_here[: len(runs)] |= runs % np.uint64(CHUNK) == 0
        start = np.flatnonzero(cut_here & self.valid)
        end = np.append(start[1:], len(self.h))
        return start, np.minimum(end, (self.off + self.n - self.width + 1)[self.doc[start]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, some at a time."""
    for b in batches:
        sizes = pc.binary_length(b.column("_text")).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > SLICE:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Places of ids in order; equal ids share one, null comes last."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _known(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each window the row of the same window with the smallest id of the slice,
    if that is smaller than its own (else -1). So of a window that many documents
    have, few rows of a slice ask the index."""
    order = np.lexsort((rank, h2, h1))
    a, b = h1[order], h2[order]
    head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    lead = order[head][np.cumsum(head) - 1]
    out = np.empty(len(order), np.int64)
    out[order] = np.where(rank[order] > rank[lead], lead, -1)
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_key, _k2, _id, _text; _key and _k2 name a row by its id and text."""
    named = docs.select(F.xxhash64(F.col(id_col), row_tag(text_col)).alias("_key"), F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return named.select("_key", F.xxhash64("_id").alias("_k2"), "_id", "_text")


DOC = ["_key", "_k2"]
SEED = ["h1", "h2", "_id", *DOC, "first", "to_key", "to_k2", "to_first"]


def _seeds(b: pa.RecordBatch, p: Slice, at: np.ndarray) -> list[pa.Array]:
    """The columns SEED of the windows at some places: to_... tell where the slice has them under a smaller id."""
    of = p.doc[at]
    h1, h2 = (p.hashed(k, at, at + p.width) for k in (0, 1))
    to = _known(h1, h2, _ranks(b.column("_id"))[of])
    ids, keys, k2 = (b.column(c).take(pa.array(of)) for c in ("_id", *DOC))
    first, to = pa.array((at - p.off[of]).astype(np.int32)), pa.array(to, mask=to < 0)
    return [pa.array(h1), pa.array(h2), ids, keys, k2, first, keys.take(to), k2.take(to), first.take(to)]


def _kinds(src: DataFrame) -> str:
    return f"h1 long, h2 long, _id {src.schema['_id'].dataType.simpleString()}, _key long, _k2 long, first int, to_key long, to_k2 long, to_first int"


def _chunk_rows(src: DataFrame, width: int) -> DataFrame:
    """SEED, last, rare: one row per chunk, with its first window as anchor; rare has the least run hashes of its windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            p = Slice(b.column("_text").to_pylist(), width)
            runs = p.runs()
            start, end = p.chunks(runs)
            if not len(start):
                continue
            m = p.rarest(runs)
            new = p.valid.copy()
            new[1:] &= m[1:] != m[:-1]
            new[start] = True
            at = np.flatnonzero(new)
            lists = np.append(np.searchsorted(at, start), len(at)).astype(np.int32)
            last = pa.array((end - p.off[p.doc[start]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*_seeds(b, p, start), last, pa.ListArray.from_arrays(pa.array(lists), pa.array(m[at]))], [*SEED, "last", "rare"])

    return src.mapInArrow(each, _kinds(src) + ", last int, rare array<long>")


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    c = b.column(name)
    return pc.list_flatten(c).to_numpy(zero_copy_only=False), pc.list_parent_indices(c).to_numpy()


def _window_rows(rows: DataFrame, width: int) -> DataFrame:
    """SEED of the windows that begin outside of the row's ranges and whose rarest run
    is among the shared ones; of equal windows of a document the first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            p = Slice(b.column("_text").to_pylist(), width)
            # a run shared by another row of the slice does no harm here
            free = p.valid & np.isin(p.rarest(p.runs()), _flat(b, "shared")[0])
            depth = np.zeros(len(p.h) + 1, np.int64)
            for name, step in (("firsts", 1), ("lasts", -1)):
                at, of = _flat(b, name)
                np.add.at(depth, at.astype(np.int64) + p.off[of], step)
            at = np.flatnonzero(free & (np.cumsum(depth)[:-1] == 0))
            if len(at):
                pairs = np.column_stack([p.doc[at], p.hashed(0, at, at + width)])
                at = at[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]
                yield pa.RecordBatch.from_arrays(_seeds(b, p, at), SEED)

    return rows.select(*DOC, "_id", "_text", "shared", "firsts", "lasts").mapInArrow(each, _kinds(rows))


def _holders(rows: DataFrame) -> DataFrame:
    """DOC, first, to_key, to_k2, to_first: windows that a document with a smaller id
    has (a null id is larger than any), with the first such document. One shuffle,
    and a block is read in order; what a slice knows by itself doesn't ask."""
    asking = rows.where("to_key is null")
    holder = F.first(F.struct("_id", *DOC, "first")).over(Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("_id")))
    found = asking.withColumn("_to", holder).where(F.col("_to._id").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_to._id"))))
    answered = found.select(*DOC, "first", F.col("_to._key").alias("to_key"), F.col("_to._k2").alias("to_k2"), F.col("_to.first").alias("to_first"))
    return rows.where("to_key is not null").select(answered.columns).union(answered)


def _stretches(batches: Iterator[pa.RecordBatch], width: int, reach: int) -> Iterator[pa.RecordBatch]:
    """One row for each ask of a document: the words around its places, and where they begin."""
    for b in _slices(batches):
        out = []
        for key, k2, text, asks in zip(*(b.column(c).to_pylist() for c in (*DOC, "_text", "asks")), strict=True):
            words = text.encode().split()
            for q in asks:
                a = max(0, q["least"] - reach)
                body = b" ".join(words[a : q["most"] + width + reach])
                out.append({"to_key": q["to_key"], "to_k2": q["to_k2"], "copy": q["copy"], "asks": True, "_key": key, "_k2": k2, "at": a, "shift": q["shift"], "body": body.decode()})
        if out:
            yield pa.RecordBatch.from_pylist(out, _ASK)


_ASK = pa.schema([("to_key", pa.int64()), ("to_k2", pa.int64()), ("copy", pa.int32()), ("asks", pa.bool_()), *((c, pa.int64()) for c in DOC), ("at", pa.int32()), ("shift", pa.int32()), ("body", pa.string())])
ASK = "to_key long, to_k2 long, copy int, asks boolean, _key long, _k2 long, at int, shift int, body string"


def _runs(same: np.ndarray, low: int, width: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least `width` true values, counted from low."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))) + low
    return [(s, e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= width]


def _extended(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Ranges of windows of the factors that each stretch has with the reference text
    before it. Both are laid along their diagonal; runs of equal words that are
    long enough are factors. One reference text is held at a time."""
    known = Slice.known
    hashed = lambda words: np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    ref: list[bytes] = []
    rh = np.zeros(0, np.uint64)
    for b in batches:
        out = []
        for asks, key, k2, at, shift, body in zip(*(b.column(c).to_pylist() for c in ("asks", *DOC, "at", "shift", "body")), strict=True):
            words = body.encode().split()
            if not asks:
                ref, rh = words, hashed(words)
                continue
            d = at - shift  # the stretch's first word lies beside this word of the reference
            low, high = max(0, -d), min(len(words), len(ref) - d)
            if high - low < width:
                continue
            runs = _runs(hashed(words[low:high]) == rh[low + d : high + d], low, width)
            if any(words[s:e] != ref[s + d : e + d] for s, e in runs):  # different words with one hash
                runs = _runs(np.array([x == y for x, y in zip(words[low:high], ref[low + d : high + d], strict=True)]), low, width)
            out += [(key, k2, at + s, at + e - width + 1) for s, e in runs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*DOC, "first", "last"])


def _factors(asked: DataFrame, src: DataFrame, width: int, reach: int) -> DataFrame:
    """DOC, first, last: the factors around the answered places (rows of _holders). src is dealt by DOC."""
    diagonal = (F.col("first") - F.col("to_first")).alias("shift")
    asks = cut(asked.groupBy(*DOC, "to_key", "to_k2", diagonal).agg(F.min("first").alias("least"), F.max("first").alias("most")))
    copies = cut(asks.groupBy("to_key", "to_k2").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("copies")))
    own = asks.join(copies, ["to_key", "to_k2"]).withColumn("copy", F.pmod("_key", "copies").cast("int"))
    own = own.groupBy(*DOC).agg(F.collect_list(F.struct("to_key", "to_k2", "copy", "shift", "least", "most")).alias("asks"))
    stretches = src.join(own, DOC).select(*DOC, "_text", "asks").mapInArrow(lambda b: _stretches(b, width, reach), ASK)
    held = src.join(copies.withColumnsRenamed({"to_key": "_key", "to_k2": "_k2"}), DOC)
    none = [F.lit(None).cast("long").alias(c) for c in DOC] + [F.lit(None).cast("int").alias(c) for c in ("at", "shift")]
    held = held.select(F.col("_key").alias("to_key"), F.col("_k2").alias("to_k2"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), *none, F.col("_text").alias("body"))
    block = ["to_key", "to_k2", "copy"]
    laid = held.union(stretches).repartition(*block).sortWithinPartitions(*block, "asks")
    return laid.mapInArrow(lambda b: _extended(b, width), "_key long, _k2 long, first int, last int")


def _ranges(rows: DataFrame) -> DataFrame:
    """DOC, firsts, lasts: the ranges of windows of each document, sorted."""
    every = rows.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"))
    return every.select(*DOC, F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"))


def factored(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text of each row of docs, with firsts and lasts: the ranges of windows that
    begin in a document with a smaller id too (sorted, ends exclusive; may be null), but
    for windows of the second step that are equal within a document: of these the first."""
    chunks = cut(_chunk_rows(_source(docs, id_col, text_col), width))
    src = _source(docs, id_col, text_col).repartition(*DOC)
    ranges = cut(_ranges(_factors(_holders(chunks.select(*SEED)), src, width, REACH)))
    # chunks that no factor holds as a whole go on
    held = F.exists(F.arrays_zip("firsts", "lasts"), lambda r: (r["firsts"] <= F.col("first")) & (r["lasts"] >= F.col("last")))
    open_ = chunks.select(*DOC, "first", "last", "rare").join(ranges, DOC, "left").where(~F.coalesce(held, F.lit(False)))
    rare = open_.select(*DOC, F.explode("rare").alias("m")).select("m", *DOC).repartition("m")
    # chunks that touch tell of the same run, so documents are counted and not rows
    several = rare.groupBy("m").agg(F.min(F.struct(*DOC)).alias("a"), F.max(F.struct(*DOC)).alias("b")).where("a <> b").select("m")
    shared = cut(rare.join(several, "m").groupBy(*DOC).agg(F.collect_set("m").alias("shared")))
    asking = src.join(shared, DOC).join(ranges, DOC, "left")
    single = _factors(_holders(cut(_window_rows(asking, width))), src, width, 0)
    every = ranges.select(*DOC, F.explode(F.arrays_zip("firsts", "lasts")).alias("r")).select(*DOC, F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"))
    return src.join(_ranges(every.union(single)), DOC, "left").select("_id", "_text", "firsts", "lasts")


def _repeats(words: list[bytes], firsts: list[int], lasts: list[int], width: int) -> list[tuple[int, int]]:
    """Ranges of the windows outside of these that are equal to one inside: within a
    document, equal windows have one answer."""
    p = Slice([b" ".join(words).decode()], width)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, firsts, 1)
    np.add.at(inside, lasts, -1)
    n = len(words) - width + 1
    inside = np.cumsum(inside)[:n] > 0
    h = p.hashed(0, np.arange(n), np.arange(n) + width)
    known = {int(x): int(i) for x, i in zip(h[inside][::-1], np.flatnonzero(inside)[::-1], strict=True)}
    again = np.flatnonzero(~inside & np.isin(h, h[inside]))
    return [(int(i), int(i) + 1) for i in again if words[i : i + width] == words[known[int(h[i])] : known[int(h[i])] + width]]


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_words, n_removed, kept (the words left, joined by
    one space), starts, ends (of the stretches of words removed; ends exclusive).

    A word goes if it is in a window of `width` words that begins in a row with
    a smaller id too. Windows are those of the input. Rows with equal ids take
    nothing from each other; a null id is larger than any. A null text has no
    words. Repeated rows get a result each; other columns are ignored.
    """
    if width < RUN:
        raise ValueError(f"windows have {RUN} words at least")
    rows = factored(docs, width, id_col, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sizes, gone, kept, starts, ends = [], [], [], [], []
            for text, firsts, lasts in zip(*(b.column(c).to_pylist() for c in ("_text", "firsts", "lasts")), strict=True):
                words = text.encode().split()
                left, s, e, at = [], [], [], 0
                ranges = list(zip(firsts or (), lasts or (), strict=True))
                if ranges:
                    ranges = sorted(ranges + _repeats(words, firsts, lasts, width))
                for first, last in ranges:
                    if e and first <= e[-1]:
                        e[-1] = max(e[-1], last + width - 1)
                    else:
                        s.append(first)
                        e.append(last + width - 1)
                for x, y in zip(s, e, strict=True):
                    left += words[at:x]
                    at = y
                left += words[at:]
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                starts.append(s)
                ends.append(e)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *lists], [id_col, "n_words", "n_removed", "kept", "starts", "ends"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"`{id_col}` {kind}, n_words long, n_removed long, kept string, starts array<long>, ends array<long>")
