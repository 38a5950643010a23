import random

from quantloom.llm import substring


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            least[s] = min(least.get(s, (True, 0)), (i is None, i or 0))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (i is None, i or 0):
                gone |= set(range(k, k + width))
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def check(spark, rows, width=13):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, h1 int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(df, width).collect())
    assert got == brute(rows, width)
    return got


def test_passages_that_repeat(spark):
    rnd = random.Random(7)
    new = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    shared = [new(n) for n in (12, 13, 14, 40, 200, 500)]
    rows = []
    for i in range(60):
        t = new(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            t += p[a : a + rnd.randrange(1, len(p) + 1)] + new(rnd.randrange(3))
        rows.append((i * 7 % 60, rnd.choice([" ", "\n", "  \t"]).join(t)))
    assert sum(r[2] for r in check(spark, rows)) > 1000


def test_rows_of_all_kinds(spark):
    text = " ".join(map(str, range(30)))
    rows = [(3, text), (3, text), (1, "x " + text + " y"), (None, text), (None, text), (2, None), (4, ""), (5, "a " * 40000), (6, "a " * 30), (7, "é " * 12), (8, "a " * 40000), (9, " ".join(map(str, range(29, -1, -1))))]
    check(spark, rows)
    check(spark, rows, 7)


def test_one_reference_asked_by_many(spark, monkeypatch):
    """A passage that most documents share, in several copies of its reference, and words that repeat."""
    monkeypatch.setattr(substring, "ASKS", 3)
    monkeypatch.setattr(substring, "REACH", 20)
    monkeypatch.setattr(substring, "SLICE", 1 << 12)
    rnd = random.Random(3)
    new = lambda n: [f"w{rnd.randrange(90)}" for _ in range(n)]
    common, other = new(120), new(40)
    rows = []
    for i in range(80):
        t = new(rnd.randrange(20)) + common[rnd.randrange(30) : 120 - rnd.randrange(30)] + new(rnd.randrange(3)) + ["a"] * rnd.randrange(60) + other[: rnd.randrange(40)]
        t[rnd.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    assert sum(r[2] for r in check(spark, rows)) > 3000


def test_runs_of_equal_words():
    import numpy as np

    same = np.array([1, 1, 0, 1, 1, 1, 0, 1], bool)
    assert substring._runs(same, 5, 2) == [(5, 7), (8, 11)]
    assert substring._runs(same[:0], 0, 1) == []


def test_empty(spark):
    assert substring.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, "one two"), (2, "one two")])
