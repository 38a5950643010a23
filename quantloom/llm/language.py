"""Language identification by inference of a mixture of languages.

A model holds, for each language, the likelihood of hashed character trigrams.
For a document, expectation-maximisation estimates which share of its trigrams
each language gave; languages are then taken out of the set one after another
as long as that raises the likelihood less a penalty for each language. So a
document of two languages gets both, and one of one language only that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.llm.common import boxed

#: Trigrams are hashed to so many values: this and the number of languages bound the model.
BUCKETS = 1 << 15
#: Languages at most; more raise an error.
MOST_LANGUAGES = 512
ROUNDS = 15
#: Loss of log-likelihood, in units of log(number of trigrams), that one more language must make good.
PENALTY = 3.0
UNKNOWN = "und"
#: Code points that are counted at a time.
PIECE = 1 << 20
#: Numerals are no letters, nor are marks.
NOT_LETTERS = regex.compile(r"\P{L}+")
#: Of the likelihood that all but a hundredth of a language's held-out texts reach, the share that a text must reach to be accepted.
SHARE = 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased words of a text, each with a
    space on both sides. All zero if it has no letter."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text or ""), PIECE):
        words = NOT_LETTERS.sub(" ", text[at : at + PIECE].lower()).strip()
        if not words:
            continue
        c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(29)
        counts += np.bincount(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return counts


def trained(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-likelihoods (bucket by language), from all rows
    with a text and a language. Each task adds up its own counts, so what moves
    is bounded by the model's size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))[:] += trigrams(text.as_py())
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    # languages are counted first, so that a column that names none (ids, say) costs no model of it
    if docs.select(F.col(lang_col)).where(F.col(lang_col).isNotNull()).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would not fit in an executor")
    counts = labelled.mapInArrow(each, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # BUCKETS rows a language at most
    names = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(names)), 0.5)
    if names:
        place = {x: i for i, x in enumerate(names)}
        np.add.at(table, (found["bucket"].to_numpy(), found["lang"].map(place).to_numpy()), found["n"].to_numpy())
    return names, np.log(table / table.sum(0)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p (likelihoods) for counts n, and the log-likelihood."""
    theta = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] > 1:
        for _ in range(ROUNDS):
            r = p * theta
            r /= r.sum(1, keepdims=True)
            theta = n @ r / n.sum()
    return theta, float(n @ np.log(p @ theta))


def mixture(counts: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> tuple[dict[int, float], float]:
    """Proportion by language (column of the model), for those in the set chosen, and
    the log-likelihood of a trigram under it over that of equally likely trigrams."""
    at = np.flatnonzero(counts)
    if not len(at) or not model.shape[1]:
        return {}, float("-inf")
    n, logs = counts[at].astype(float), model[at].astype(float)
    most = logs.max(1, keepdims=True)
    logs -= most  # a factor for each trigram changes no comparison
    p = np.exp(np.maximum(logs, -30))
    chosen = list(range(p.shape[1]))
    theta, fit = _em(p, n)
    cost = penalty * np.log(n.sum() + 1)
    while len(chosen) > 1:
        out = int(theta.argmin())
        rest = chosen[:out] + chosen[out + 1 :]
        less, fit_less = _em(p[:, rest], n)
        if fit - fit_less > cost:
            break
        chosen, theta, fit = rest, less, fit_less
    gain = (fit + float(n @ most[:, 0])) / n.sum() + float(np.log(BUCKETS))
    return dict(zip(chosen, theta.tolist(), strict=True)), gain


def identified(docs: DataFrame, model: Broadcast, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred (the language with the largest share), score (that
    share), lang_mix (share by language of the set chosen) and lang_gain (how
    much likelier, in nats a trigram, the set makes the text than equally likely
    trigrams would); columns of those names are replaced. A null text, or one
    without a letter, is "und" with score 0, an empty mix and no gain, as is any
    if the model has no language. Of equal shares the language first in order
    stands. Repeated rows get equal results."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_mix", "lang_gain")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    new = {"lang_pred": pa.string(), "score": pa.float64(), "lang_mix": pa.map_(pa.string(), pa.float64()), "lang_gain": pa.float64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in batches:
            pred, score, mix, gains = [], [], [], []
            for t in b.column(text_col):
                m, gain = mixture(trigrams(t.as_py()), table, penalty)
                gains.append(gain if m else None)
                best = max(m, key=lambda k: (m[k], -k)) if m else None
                pred.append(UNKNOWN if best is None else names[best])
                score.append(0.0 if best is None else min(1.0, m[best]))
                mix.append([(names[k], v) for k, v in m.items()])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, kind) for x, kind in zip((pred, score, mix, gains), new.values(), strict=True))], [*own, *new])

    made = StructType.fromDDL("lang_pred string, score double, lang_mix map<string,double>, lang_gain double")
    return docs.mapInArrow(each, StructType([*docs.schema.fields, *made.fields]))


def model_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Broadcast:
    """trained(), sent to all executors: BUCKETS x MOST_LANGUAGES floats (64 MB) at most."""
    return docs.sparkSession.sparkContext.broadcast(trained(docs, text_col, lang_col))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def bars(docs: DataFrame, model: Broadcast, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language of the model, what all but a hundredth of its texts in docs
    gain, in nats a trigram, over equally likely trigrams. One number a language."""
    names = model.value[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for b in batches:
            langs, gains = [], []
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                n = trigrams(text.as_py())
                if lang.as_py() in place and n.any():
                    at = np.flatnonzero(n)
                    langs.append(lang.as_py())
                    gains.append(float(n[at] @ model.value[1][at, place[lang.as_py()]].astype(float)) / n.sum() + float(np.log(BUCKETS)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(gains, pa.float64())], ["lang", "gain"])

    told = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    low = told.mapInArrow(each, "lang string, gain double").groupBy("lang").agg(F.percentile_approx("gain", 0.01, 10000).alias("low"))
    return {r.lang: r.low for r in low.collect()}


def accepted(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with their columns (of any names), that a set of known
    languages, one or several, explains: their lang_gain reaches `share` of its
    languages' bars(), each by its part of the text.

    Rows with a null text or without a letter go; repeated rows stay or go
    together. The model is of docs whose fold of 4 isn't 2 (all rows, if no such
    row has a language), the bars are of those whose fold is 2; a language that
    has no text there asks for any gain at all.
    """
    held = F.coalesce(fold(id_col, 4), F.lit(0)) == 2
    model = model_of(docs.where(~held), text_col, lang_col)
    if not model.value[0]:
        model = model_of(docs, text_col, lang_col)
    low = bars(docs.where(held), model, text_col, lang_col)
    found = identified(boxed(docs, F.col(text_col).alias("_text")), model, "_text")
    asked = F.create_map(*[F.lit(x) for lang, bar in low.items() for x in (lang, max(0.0, bar) * share)]) if low else F.create_map().cast("map<string,double>")
    bar = F.aggregate(F.map_entries("lang_mix"), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.try_element_at(asked, e["key"]), F.lit(0.0)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_gain") > bar)).select("row.*")
