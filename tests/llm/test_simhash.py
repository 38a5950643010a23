import random

import xxhash
from pyspark.sql import functions as F

from quantloom.llm import queries, simhash
from quantloom.llm.components import components


def fingerprint(text, width):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), seed=42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingle_set(text, width):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def groups(values, linked):
    """Root of each value; roots are found by searching on from each value."""
    root = {}
    for v in values:
        if v not in root:
            todo, root[v] = [v], v
            while todo:
                x = todo.pop()
                for y in values:
                    if y not in root and linked(x, y):
                        root[y] = v
                        todo.append(y)
    return root


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: fingerprint(t, 3) for i, t in docs.items()}
    root = groups(sorted(set(fp.values())), near)
    least = {}
    for i in sorted(docs, reverse=True):
        least[root[fp[i]]] = i
    got = queries.op5_simhash_near_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == least[root[fp[r.doc_id]]]


def test_links_of_crowds(spark):
    """Values around a few centres, and long chains."""
    rnd = random.Random(5)
    values = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(60)}
        for _ in range(20):
            c ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            values.add(c)
    values = sorted(values)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(signed[v],) for v in values], "fp long")
    edges = simhash.links(df)
    got = {r.node: r.root for r in components(edges).collect()}
    root = groups(values, near)
    for a in values:
        for b in values:
            same = got.get(signed[a], signed[a]) == got.get(signed[b], signed[b])
            assert same == (root[a] == root[b])


def test_likeness_against_all_pairs(spark):
    """Edited copies at all distances, copies of copies, and a passage that many texts hold."""
    rnd = random.Random(11)
    new = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    passage, rows = new(80), []
    for _ in range(12):
        base = new(rnd.choice([60, 150, 400]))
        for _ in range(8):
            t = list(base)
            for _ in range(rnd.randrange(len(t) // 12)):
                t[rnd.randrange(len(t))] = "edit"
            rows.append(" ".join(t))
            if rnd.random() < 0.3:
                base = t
    rows += [" ".join(new(90) + passage) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, least=0.8).collect()}
    sets = [shingle_set(t, 5) for t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 20 and all(got[i] == got[j] for i, j in alike)
    touched = {i for p in alike for i in p}
    assert all(got[i] == i for i in range(len(rows)) if i not in touched)


def test_likeness_in_a_large_family(spark):
    """Copies that are each like the original, and not like each other."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(64)]
    rows = set()
    while len(rows) < 1000:
        t = list(words)
        t[rnd.randrange(4, 60)] = f"edit{rnd.randrange(10**9)}"
        rows.add(" ".join(t))
    rows = sorted(rows)
    rows.insert(500, " ".join(words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {r.component_id for r in simhash.near_duplicates(df, 5, least=0.8).collect()} == {0}


def test_likeness_of_pairs_that_no_star_has(spark):
    """Texts of a chain, and a key that all of them hold: the rest is paired in full."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[3 * i : 3 * i + 40]) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(df, 5, least=0.8).collect()} == {0}


def test_likeness_of_short_texts_against_all_pairs(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(150):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 60))]
        rows.append(" ".join(base))
        rows.append(" ".join([*base, "more"]))
        rows.append(" ".join([*base[:-1], "last"]))
        t = list(base)
        t[rnd.randrange(len(t))] = "inside"
        rows.append(" ".join(t))
    rows.append(" ".join(["same"] * 30))
    rows.append(" ".join(["same"] * 9))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, least=0.8).collect()}
    sets, fp = [shingle_set(t, 5) for t in rows], [fingerprint(t, 5) for t in rows]
    linked = lambda i, j: near(fp[i], fp[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = groups(range(len(rows)), linked)
    assert len(set(root.values())) < len(rows) - 200
    assert got == root


def test_counters_hold_all_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    texts = [r.text for r in docs.collect()] + [None, ""]
    got = simhash.counters(docs.union(spark.createDataFrame([(None,), ("",)], "text string")), 5).value
    want = [0] * simhash.COUNTERS
    for t in texts:
        for h in {int(x) for x in simhash.shingles(t, 5)}:
            want[h % simhash.COUNTERS] += 1
    assert got.tolist() == want
    assert not simhash.counters(docs.limit(0), 5).value.any()


def test_rows_of_all_kinds(spark):
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (None, "a b c d e f"), (9, None), (8, ""), (None, "z y x w v u t"), (7, "long " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("9", "8"), ("8", "8"), ("None", "None"), ("7", "7")])
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 1), (3, 1)], "a int, b int")
    assert {r.node: r.root for r in components(df).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(df.limit(0)).count() == 0
