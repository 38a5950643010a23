import re

from quantloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items, width):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        ids.add(item)
    return len(w), len(hit), sorted(ids)


ITEMS = [("b1", "The quick Brown fox jumps"), ("b2", "one two"), ("b2", "one two"), ("b3", ""), ("b4", None), (None, "null id here"), ("b5", "a a a a a"), ("b6", "É é ÉÉ 日本"), ("b7", "x")]
DOCS = [
    (1, "Said: the QUICK brown fox. The quick brown fox jumps over", "l"),
    (1, "Said: the QUICK brown fox. The quick brown fox jumps over", "l"),
    (2, None, "l"),
    (3, "", None),
    (None, "one, two! one-two three", "l"),
    (4, "a a a a a a a a", "l"),
    (5, "é É éé 日本 É é ÉÉ 日本", "l"),
    (6, "...", "l"),
    (7, "x", "l"),
    (8, "null id here null id", "l"),
    (9, "w " * 20000 + "one two", "l"),
]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, item string")
    return docs, spark.createDataFrame(ITEMS, "item_id string, text string")


def check(spark, width, **options):
    docs, items = frames(spark)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.contamination(docs, items, width, **options).collect())
    want = sorted((str(d), *brute(t, ITEMS, width), brute(t, ITEMS, width)[1] > 0) for d, t, _ in DOCS)
    assert got == want


def test_against_brute_force(spark):
    for width in (1, 3, 5, 10):
        check(spark, width)


def test_prefixes_in_several_blocks(spark):
    check(spark, 3, block_bytes=400)


def test_filter_and_empty_tables(spark):
    docs, items = frames(spark)
    kept = decontaminate.decontaminated(docs, items, 10)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t, _ in DOCS if not brute(t, ITEMS, 10)[1])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(DOCS)
