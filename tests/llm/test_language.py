import math
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 400
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_mixture_of_two(spark):
    a, b = "the cat and the dog went there then", "le chat et le chien sont allés vers là"
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(a, "en"), (b, "fr")] * 8)], "doc_id long, text string, lang string")
    model = language.model_of(docs)
    mixed = spark.createDataFrame([(1, f"{a} {b} " * 20), (2, a * 20), (3, None), (4, "123 !"), (5, ""), (6, "漢字 漢字")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identified(mixed, model).collect()}
    assert set(got[1].lang_mix) == {"en", "fr"} and 0.3 < got[1].lang_mix["en"] < 0.7
    assert set(got[2].lang_mix) == {"en"} and got[2].score == 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (3, 4, 5))
    assert got[6].lang_pred in ("en", "fr")


def test_only_letters_count(spark):
    """Every code point that is no letter, and some that are."""
    letters = [c for c in map(chr, range(0x3000)) if unicodedata.category(c)[0] == "L"]
    others = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] not in "LC"]
    assert not any(language.trigrams(c).any() for c in others)
    assert all(language.trigrams(c).any() for c in letters)
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(8)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ"), (3, "१२३ ४"), (4, "a²")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(odd, language.model_of(docs)).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("en", 1.0)}


def test_a_language_without_labels_is_not_accepted(spark):
    """Each language's labels are taken away in turn: its texts go, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    for out in sorted({r.lang for r in rows}):
        kept = {r.doc_id for r in language.accepted(docs.withColumn("lang", F.when(F.col("lang") != out, F.col("lang")))).collect()}
        unknown, known = [r for r in rows if r.lang == out], [r for r in rows if r.lang != out and language.trigrams(r.text).any()]
        assert sum(r.doc_id in kept for r in unknown) <= 0.1 * len(unknown)
        assert sum(r.doc_id not in kept for r in known) <= 0.01 * len(known)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "words", None, "x"), (None, None, "en", "y")], "doc_id long, text string, lang string, score string")
    got = language.identified(docs, language.model_of(docs)).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]
    assert language.identified(docs.limit(0), language.model_of(docs)).count() == 0
    assert language.accepted(docs).count() == 0


def plain_em(counts, model, rounds=15):
    """Expectation-maximisation one trigram and language at a time."""
    k = model.shape[1]
    theta = [1 / k] * k
    seen = [(int(b), int(n)) for b, n in enumerate(counts) if n]
    total = sum(n for _, n in seen)
    if k > 1:
        for _ in range(rounds):
            new = [0.0] * k
            for b, n in seen:
                p = [theta[j] * math.exp(model[b][j]) for j in range(k)]
                for j in range(k):
                    new[j] += n * p[j] / sum(p)
            theta = [v / total for v in new]
    fit = sum(n * math.log(sum(theta[j] * math.exp(model[b][j]) for j in range(k))) for b, n in seen)
    return theta, fit, total


def plain_mixture(counts, model):
    chosen = list(range(model.shape[1]))
    theta, fit, total = plain_em(counts, model[:, chosen])
    while len(chosen) > 1:
        out = min(range(len(chosen)), key=lambda j: theta[j])
        rest = chosen[:out] + chosen[out + 1 :]
        less, fit_less, _ = plain_em(counts, model[:, rest])
        if fit - fit_less > language.PENALTY * math.log(total + 1):
            break
        chosen, theta, fit = rest, less, fit_less
    return dict(zip(chosen, theta, strict=True))


def test_query_against_a_plain_mixture(spark, sf):
    """Every row of the query: model, mixture and choice made one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = {r.doc_id: language.trigrams(r.text) for r in docs}
    names = sorted({r.lang for r in docs if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2})
    table = np.full((language.BUCKETS, len(names)), 0.5)
    for r in docs:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            table[:, names.index(r.lang)] += counts[r.doc_id]
    model = np.log(table / table.sum(0))
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    assert set(got) == set(counts)
    for r in docs[::4]:
        want = plain_mixture(counts[r.doc_id], model) if counts[r.doc_id].any() else {}
        best = max(want, key=lambda j: want[j]) if want else None
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert got[r.doc_id].lang_pred == ("und" if best is None else names[best])
        assert abs(got[r.doc_id].score - (want[best] if want else 0)) < 1e-3


def test_several_languages_are_accepted(spark):
    texts = {"en": "the cat and the dog went there then with them", "fr": "le chat et le chien sont partis là bas avec eux", "de": "der hund und die katze gingen dann dorthin zusammen", "es": "el gato y el perro fueron entonces hacia ellos"}
    rows = [(i, t, x) for i, (x, t) in enumerate(list(texts.items()) * 8)]
    rows += [(100, " ".join([f"{t} " * 20 for t in texts.values()]), None), (101, "漢字仮名交文 " * 40, None), (102, "123 456", None), (103, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.accepted(docs).collect()}
    assert kept == set(range(32)) | {100}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.trained(docs)


def test_labels_in_the_unseen_fold_only(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:4]
    docs = spark.createDataFrame([(i, "the cat and the dog went there then", "en") for i in ids], "doc_id long, text string, lang string")
    assert language.accepted(docs).count() == 4


def test_long_text_in_pieces(monkeypatch):
    whole = language.trigrams("one two three " * 50)
    monkeypatch.setattr(language, "PIECE", 70)
    assert abs(language.trigrams("one two three " * 50).sum() - whole.sum()) < 40
