"""Phrase collocations by pivot partitioning.

Every contiguous phrase of a piece of text is counted in one place only: that
of its rarest word, the pivot. A first pass counts words. In the second each
occurrence of a word that is frequent enough sends the fragment around it in
which no word is rarer, at most three words on either side; words that are too
rare for any phrase are gaps that end fragments. What meets under a pivot is
mined there: a phrase is counted at the leftmost of its rarest words, so its
occurrences are all in one group and each is counted once. Pivots that very
many words are get several groups, whose sums are added up afterwards.

Order among words comes from a table of fixed size (the largest count of the
frequent words that share a counter, then a hash), so nothing that is sent to
all tasks grows with the vocabulary. Any order gives the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import cut

UNKNOWN = "und"
LEAST, LONGEST, KEEP = 30, 4, 2000
#: Counters that order words, and those that travel in one row.
COUNTERS, SLICE = 1 << 22, 1 << 12
#: Occurrences of a pivot for which a group of its own is made, fragments in a row, and bytes of text taken at a time.
GROUP, PACK, CHUNK = 1 << 18, 256, 1 << 22
#: Bytes by class: 0 in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: their bytes, where each begins in them (and the last ends),
    and whether it begins a piece."""
    kind = KINDS[data]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = word[heads]
    begin = np.flatnonzero(first)
    offsets = np.append(np.cumsum(word)[begin] - 1, word.sum()) if len(begin) else np.zeros(1, np.int64)
    piece = np.cumsum(kind == 2)[begin] + np.searchsorted(at[:-1], begin, "right")  # both only grow
    new = np.ones(len(begin), bool)
    new[1:] = piece[1:] != piece[:-1]
    return data[word], offsets.astype(np.int64), new


def _words(data: np.ndarray, offsets: np.ndarray) -> pa.DictionaryArray:
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return made.dictionary_encode()


def _joined(words: pa.Array, codes: np.ndarray, sizes: np.ndarray, by: str) -> pa.Array:
    """Strings of so many words each, taken one after another."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words.take(pa.array(codes)))
    return pc.binary_join(lists, pa.scalar(by, words.type))


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (so many as sizes says) of each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """lang, bytes and offsets of texts of one language, some CHUNK of bytes at a
    time. Longer texts are cut between pieces, so that only a piece must fit."""
    for lang in pc.unique(b.column(0)):
        texts = b.column(1).filter(pc.equal(b.column(0), lang))
        data, at = _buffers(texts)
        data, i = LOWER[data], 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            low, high = int(at[i]), int(at[j])
            if j == i + 1 and high - low > CHUNK:  # a long text
                while low < high:
                    stops = np.flatnonzero(KINDS[data[low + CHUNK : high]] == 2) if high - low > CHUNK else []
                    end = low + CHUNK + int(stops[0]) if len(stops) else high
                    yield lang.as_py(), data[low:end], np.array([0, end - low])
                    low = end
            else:
                yield lang.as_py(), data[low:high], at[i : j + 1] - low
            i = j


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase (a word), a: occurrences."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data, at in _chunks(b):
                data, offsets, _ = tokens(data, at)
                w = _words(data, offsets)
                n = np.bincount(w.indices.to_numpy(), minlength=len(w.dictionary))
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), w.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    found = _source(docs, text_col, lang_col).mapInArrow(each, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat_ws("\t", word, lang))


def _key(lang: str, words: pa.Array) -> np.ndarray:
    """_hash() in a task (a word has no tab, so no two pairs are joined to one text)."""
    end = b"\t" + lang.encode()
    return np.array([xxhash.xxh64_intdigest(w.encode() + end, 42) for w in words.to_pylist()], np.uint64).view(np.int64)


def counters(words: DataFrame, least: int) -> Broadcast:
    """For each of COUNTERS values of a word's hash, how often the most frequent of
    its words occurs, of those that occur `least` times. One size for any vocabulary."""
    slot = F.pmod(_hash(F.col("lang"), F.col("phrase")), F.lit(COUNTERS))
    most = words.where(F.col("a") >= least).groupBy(slot.alias("slot")).agg(F.least(F.max("a"), F.lit(2**31 - 1)).cast("int").alias("n"))
    rows = most.groupBy(F.floor(F.col("slot") / SLICE).alias("s")).agg(F.collect_list((F.col("slot") % SLICE).cast("int")).alias("i"), F.collect_list("n").alias("n"))  # SLICE values at most
    table = np.zeros((COUNTERS // SLICE, SLICE), np.int32)
    for s, i, n in rows.toLocalIterator():
        table[s, i] = n
    return words.sparkSession.sparkContext.broadcast(table.reshape(-1))


def fragments(docs: DataFrame, counts: Broadcast, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, key (the pivot's hash), part, parts, found: fragments of a pivot, one a
    line, each with the number of words before the pivot (one digit) in front."""
    reach = longest - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data, at in _chunks(b):
                data, offsets, new = tokens(data, at)
                w = _words(data, offsets)
                code = w.indices.to_numpy()
                key = _key(lang, w.dictionary)
                n = counts.value[np.mod(key, COUNTERS)]
                rank = np.empty(len(n), np.int64)
                rank[np.lexsort((key, n))] = np.arange(len(n))
                rank[n == 0] = -1
                # words with a gap before each piece and room at the ends
                place = np.arange(len(code)) + np.cumsum(new) + reach
                line = np.full(len(code) + int(new.sum()) + 2 * reach + 1, -1)
                line[place] = rank[code]
                t = np.flatnonzero(rank[code] >= 0)
                p = place[t]
                own = line[p]
                sides = []
                for step, more in ((-1, np.greater), (1, np.greater_equal)):
                    on, size = np.ones(len(p), bool), np.zeros(len(p), np.int64)
                    for k in range(1, reach + 1):
                        on = on & more(line[p + step * k], own)
                        size += on
                    sides.append(size)
                some = np.flatnonzero(sides[0] + sides[1] > 0)
                if not len(some):
                    continue
                t, left, size = t[some], sides[0][some], sides[0][some] + sides[1][some] + 1
                parts = -(-n[code[t]].astype(np.int64) // GROUP)
                part = (t * 40503 >> 4) % parts
                by = key[code[t]]
                order = np.lexsort((part, by))
                t, left, size, parts, part, by = (x[order] for x in (t, left, size, parts, part, by))
                texts = _joined(w.dictionary, code[_runs(t - left, size)], size, " ")
                texts = pc.binary_join_element_wise(pa.array(left).cast(texts.type), texts, pa.scalar("", texts.type))
                head = np.ones(len(t), bool)
                head[1:] = (by[1:] != by[:-1]) | (part[1:] != part[:-1])
                run = np.arange(len(t)) - np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
                begin = np.flatnonzero(run % PACK == 0)
                packed = _joined(texts, np.arange(len(t)), np.diff(np.append(begin, len(t))), "\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(begin)), pa.array(by[begin]), pa.array(part[begin], pa.int32()), pa.array(parts[begin], pa.int32()), packed.cast(pa.string())], ["lang", "key", "part", "parts", "found"]
                )

    return _source(docs, text_col, lang_col).mapInArrow(each, "lang string, key long, part int, parts int, found string")


def _mined(lang: str, parts: np.ndarray, found: pa.Array, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that hold their fragment's pivot; those of whole groups from `least` on."""
    data, at = _buffers(found)
    lines = np.searchsorted(at, np.flatnonzero(data == 0x0A), "right") - 1
    whole = np.repeat(parts == 1, np.bincount(lines, minlength=len(parts)) + 1)  # by fragment
    data, offsets, new = tokens(data, at)
    head = np.flatnonzero(new)
    left = data[offsets[head]].astype(np.int64) - ord("0")
    keep = np.ones(len(data), bool)
    keep[offsets[head]] = False
    offsets = offsets - np.append(0, np.cumsum(new))
    w = _words(data[keep], offsets)
    code = w.indices.to_numpy().astype(np.int64)
    pair = np.zeros(len(code), np.int64)
    if len(code) > 1:
        pair[:-1] = np.unique(code[:-1] << 32 | code[1:], return_inverse=True)[1]
    size = np.diff(np.append(head, len(code)))
    for n in range(2, longest + 1):
        begin, of = [], []
        for j in range(n):  # words before the pivot
            ok = np.flatnonzero((left >= j) & (left - j + n <= size))
            begin.append((head + left)[ok] - j)
            of.append(ok)
        begin, of = np.concatenate(begin), np.concatenate(of)
        name = pair[begin]
        for k in range(2, n):  # n - 1 pairs tell n words
            name = np.unique(name << 32 | pair[begin + k - 1], return_inverse=True)[1]
        _, one, times = np.unique(name, return_index=True, return_counts=True)
        good = (times >= least) | ~whole[of[one]]
        one, times = one[good], times[good]
        if len(one):
            phrase = _joined(w.dictionary, code[_runs(begin[one], np.full(len(one), n))], np.full(len(one), n), " ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one)), phrase.cast(pa.string()), pa.array(times, pa.int64())], ["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, a: phrases of 2 to `longest` words that occur `least` times or more."""
    sent = fragments(docs, counters(words, least), longest, text_col, lang_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next one."""
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            lang, key, part = (held.column(i).combine_chunks() for i in range(3))
            last = len(held) - 1
            same = pc.and_(pc.equal(lang, lang[last]), pc.and_(pc.equal(key, key[last]), pc.equal(part, part[last])))
            at = pc.index(same, True).as_py()
            yield from mined(held.slice(0, at))
            held = held.slice(at)
        if held is not None:
            yield from mined(held)

    def mined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(t.column("lang")):
            mine = t.filter(pc.equal(t.column("lang"), lang))
            yield from _mined(lang.as_py(), mine.column("parts").to_numpy(), mine.column("found").combine_chunks(), least, longest)

    groups = sent.repartition("lang", "key", "part").sortWithinPartitions("lang", "key", "part")
    found = groups.mapInArrow(each, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `keep` phrases of 2 to
    `longest` words (at most 9).

    Texts are lower-cased (A-Z), split at .,;:!? and line ends into pieces and
    those at spaces and tabs into words; null and empty texts have none, rows
    without a language count as "und", and repeated rows count each. a is how
    often a phrase occurs (`least` times or more). Cut in two, its parts occur
    l and r times, and its score is floor(2000000 a / (l + r)) of the cut that
    scores lowest, the first of equal ones. Phrases inside a longer one that
    occurs 0.8 times as often or more are left out. Equal scores are ordered by
    a, then by the phrase's bytes. n counts the language's words. No texts give
    no rows; other columns are ignored.
    """
    if not 2 <= longest <= 9:
        raise ValueError("phrases of 2 to 9 words at most")
    words = cut(word_counts(docs, text_col, lang_col))
    phrases = cut(phrase_counts(docs, words, least, longest, text_col, lang_col))
    known = phrases.union(words.where(F.col("a") >= least))
    w = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    cuts = phrases.select("lang", "phrase", "a", F.size(w).alias("size"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(19,0)) * 2000000BD div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    inner = phrases.withColumn("size", F.size(w)).where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    big = lambda c, by: F.col(c).cast("decimal(19,0)") * by
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer", 100) < big("a", 80)))
    left = left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = left.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= keep)
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
