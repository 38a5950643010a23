"""Each stage against brute force on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import words
from test_secrets import base
from test_simhash import fingerprint, groups, near, shingle_set

from quantloom.llm.common import cut


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    columns = docs.columns
    ins, outs = [], []
    for _, f in corpus_pipeline.STAGES:
        ins.append(docs.collect())
        docs = cut(f(spark, docs, sf))
        outs.append(docs.collect())
    assert docs.columns == [*columns, "copy_no"]
    # language: what has no letter goes, and little else
    kept = {r.doc_id for r in outs[0]}
    for r in ins[0]:
        assert r.doc_id in kept or not re.search(r"[^\W\d_]{3}", r.text or "") or len(r.text) < 400
    assert len(kept) > 0.9 * len(ins[0])
    # near duplicates: the smallest id of each group
    fp = {r.doc_id: fingerprint(r.text, 5) for r in ins[1]}
    sets = {r.doc_id: shingle_set(r.text, 5) for r in ins[1]}
    alike = lambda a, b: near(fp[a], fp[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = groups(sorted(fp), alike)
    least = {}
    for i in sorted(fp, reverse=True):
        least[root[i]] = i
    assert len(least) < len({near_root for near_root in groups(sorted(set(fp.values())), near).values()})
    assert sorted(r.doc_id for r in outs[1]) == sorted(least.values())
    # decontamination
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in outs[2]) == sorted(r.doc_id for r in ins[2] if not hit(words(r.text)))
    # secrets: replaced, and nothing else changes
    before = {r.doc_id: r for r in ins[3]}
    assert len(outs[3]) == len(ins[3])
    for r in outs[3]:
        assert r.n_chars == len(r.text) and not base(r.text)
        if not re.search(r"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{16}|://", before[r.doc_id].text, re.I):
            assert r.text == before[r.doc_id].text
    # mixing: copies of rows that came in
    known = {r.doc_id: r.text for r in ins[4]}
    assert all(known[r.doc_id] == r.text and r.copy_no in (1, 2) for r in outs[4])
    assert len(outs[4]) > len(ins[4])


def test_run(spark, sf):
    a = corpus_pipeline.run(spark, sf)
    assert a.count() > 0 and a.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0


def test_stages_of_nothing_and_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "plain words of a text", "en", "s", 21), (2, "plain words of a text", "en", "s", 21)], docs.schema)
    for start, most in ((docs.limit(0), 0), (odd.withColumn("_row_tag_", F.lit(1)), 2)):
        df = start
        for _, f in corpus_pipeline.STAGES:
            df = cut(f(spark, df, sf))
        assert df.count() <= most
