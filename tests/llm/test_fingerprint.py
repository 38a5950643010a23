import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from quantloom.llm import fingerprint, queries

SPACE = re.compile(r"[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+")


def canonical(t):
    nfc = lambda s: unicodedata.normalize("NFC", s)
    return SPACE.sub(" ", nfc(nfc(t or "").casefold())).strip(" ")


DOCS = [(9, "Café  au\tlait"), (8, "cafe\u0301 AU lait "), (7, None), (6, ""), (5, " \n"), (5, " \n"), (4, "e\u0323\u0302 \u1e69 s\u0323\u0307"), (None, "lone"), (3, "\u1100\u1161\u11a8 각"), (2, "ab" * 50000), (1, "𝒳yz"), (0, "STRASSE"), (-1, "straße"), (-2, "ΟΔΟΣ"), (-3, "οδοσ"), (-4, "οδος"), (-5, "\u01f0 J\u030c"), (-6, "ŉ İ ſ µ")]


def edited(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 2
        out.setdefault(i, []).append((t, u, t[: len(t) - k] + u[:k]))
    return out


def frame(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("edited", F.lit("clash"))


def test_equal_forms_have_equal_fingerprints(spark):
    got = fingerprint.fingerprints(frame(spark)).select("text", "fingerprint").collect()
    for a in got:
        for b in got:
            assert (a.fingerprint == b.fingerprint) == (canonical(a.text) == canonical(b.text))
    by = {a.text: a.fingerprint for a in got}
    assert by["STRASSE"] == by["straße"] and by["ΟΔΟΣ"] == by["οδοσ"] == by["οδος"]
    groups = {r.first_id: r.copies for r in fingerprint.groups(frame(spark)).collect()}
    assert groups[8] == 2 and groups[5] == 4


def test_edits_and_likeness(spark):
    want = edited(DOCS)
    for r in fingerprint.comparison(frame(spark)).collect():
        t, u, e = next(x for x in want[r.doc_id] if x[0] == r.text and x[2] == r.edited)
        assert r.near_edited == float(canonical(t) == canonical(e)) and r.near_next == float(canonical(t) == canonical(u))
        assert (r.fingerprint == r.edited_fingerprint) == (canonical(t) == canonical(e))


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: v[0] for i, v in edited(docs).items()}
    for r in queries.op4_document_fingerprints(spark, sf).collect():
        t, u, e = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(e)), float(canonical(t) == canonical(u)))


def test_one_digest_for_several_forms(spark, monkeypatch):
    """Where digests collide, byte comparison parts the forms."""
    monkeypatch.setattr(fingerprint, "digest", lambda form: F.substring(F.sha2(F.encode(form, "UTF-8"), 256), 1, 1))
    got = fingerprint.fingerprints(frame(spark)).select("text", "fingerprint").collect()
    for a in got:
        for b in got:
            assert (a.fingerprint == b.fingerprint) == (canonical(a.text) == canonical(b.text))


def test_ids_of_other_kinds(spark):
    """Text ids, of which several rows have the same or none."""
    docs = [(None if i is None else f"id{i:03}", t) for i, t in DOCS] + [("id005", " \n")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    order = sorted({(i is None, i or "") for i, _ in docs}, key=lambda k: k, reverse=True)
    got = fingerprint.comparison(df).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    ids = [None if none else i for none, i in sorted(order, key=lambda k: (k[0], [-ord(c) for c in k[1]]))]
    texts = {i: [t or "" for j, t in docs if j == i] for i in ids}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        # of rows with one id, all but the last are followed by one of themselves
        nexts = sorted(r.next_text for r in by[i])
        assert sorted([*texts[i][1:], *texts[after][:1]]) == nexts or len(texts[i]) == 1 and nexts[0] in texts[after]


def test_many_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 4)
    df = spark.createDataFrame([(None, f"text {i}") for i in range(60)] + [(i, f"t {i}") for i in range(9)], "doc_id long, text string")
    got = fingerprint.edited(df).collect()
    # one ring through all rows
    after = {r.text: r.next_text for r in got}
    at, seen = "t 8", []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == 69 and seen[:9] == [f"t {i}" for i in range(8, -1, -1)]


def test_of_nothing_and_of_one(spark):
    assert fingerprint.comparison(frame(spark).limit(0)).count() == 0
    one = fingerprint.comparison(frame(spark).where("doc_id = 1")).first()
    assert one.near_next == 1.0
