import re
from collections import defaultdict

import pytest

from quantloom.llm import mixing, queries


def targets(sizes):
    """By sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > 2 * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, want_sizes, tolerance=None):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    assert sizes == want_sizes
    want = targets(sizes)
    for s, v in by.items():
        assert v[0].target == pytest.approx(want[s]) and v[0].source_size == sizes[s]
        taken = sum(r.copies * r.size for r in v)
        assert abs(taken - want[s]) <= max(r.size for r in v) + 1e-6
        assert all(0 <= r.copies <= 2 for r in v)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    check(mixing.mixed(docs).collect(), dict(sizes))


def test_reruns_agree_however_the_rows_lie(spark, sf):
    a = sorted(map(tuple, queries.op8_mixing(spark, sf).collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("text").repartition(7)
    b = sorted((r._id, r.size, r.source_size, r.target, r.copies * r.size) for r in mixing.mixed(docs).collect())
    assert a == b


def test_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "w " * (1 + i * i % 37), "hot" if i % 3 else f"s{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    check(mixing.mixed(df).collect(), dict(sizes))


def test_unbiased(spark):
    """Over many draws each document is taken as often as its source's rate says."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)]
    total = defaultdict(int)
    for k in range(30):
        df = spark.createDataFrame([(i + 1000 * k, t, s) for i, t, s in rows], "doc_id long, text string, source string")
        got = mixing.mixed(df).collect()
        rate = {r.source: r.target / r.source_size for r in got}
        for r in got:
            total[r.source, r.size] += r.copies
    for (s, _), n in total.items():
        assert n / (30 * 4) == pytest.approx(rate[s], abs=0.15)


def test_rows_of_all_kinds(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 2), (None, "d e", None, 3), (2, None, "x", 4), (3, "", "y", 5), (4, "f " * 100000, "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixed(df).collect()
    check(got, {"x": 6, None: 2, "y": 0, "z": 100000})
    out = mixing.mixture(df)
    assert out.columns == [*df.columns, "copy_no"]
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixture(df.limit(0)).count() == 0
