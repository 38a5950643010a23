import math
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import quality, queries


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and auc(held) > 0.9


def test_statistics(spark):
    rows = [(1, "Ab  cd\ncd cd\n\nAb"), (2, ""), (3, None), (4, "é" * 100000), (5, "!!! ### 123")]
    got = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    r = got[1]
    assert (r.s_chars, r.s_words, r.s_lines, r.s_distinct_words, r.s_word_length) == (16, 5, 3, 0.4, 2)
    assert r.s_upper == 0.2 and r.s_longest_word == 2
    assert all(v == 0 for k, v in got[2].asDict().items() if k.startswith("s_"))
    assert got[2][2:] == got[3][2:] and got[4].s_longest_word == 100000 and got[5].s_digits == pytest.approx(3 / 9)


def test_rules_find_a_conjunction(spark):
    df = spark.range(4000).select((F.rand(1) * 10).alias("s_a"), (F.rand(2) * 10).alias("s_b"))
    df = df.withColumn("label", ((F.col("s_a") > 5) & (F.col("s_b") <= 3)).cast("int"))
    model = quality.fitted(df)
    got = quality.scored(df, model, 0.5)
    assert got.where("predicted != label").count() < 40
    for r in got.limit(50).collect():  # the expression is the rules' sum
        z = model.intercept + sum(x.weight for x in model.rules if all((r[n] <= v) == most for n, most, v in x.terms))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_few_labels(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None)], "s_a double, label int")
    assert quality.fitted(df).score() is not None
    assert [round(r.score, 3) for r in quality.scored(df, quality.fitted(df)).collect()] == [0.75] * 3
    assert quality.scored(df, quality.fitted(df.limit(0))).first().score == 0.5


def test_query_against_plain_rules(spark, sf):
    """Every row of the query: the model's rules, looked at one by one."""
    stats = quality.statistics(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).drop("text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in stats.select("doc_id").collect()}
    seen = stats.join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    model = quality.fitted(seen)
    rows = {r.doc_id: r for r in stats.collect()}
    got = queries.op10_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        z = model.intercept
        for rule in model.rules:
            if all((rows[r.doc_id][name] <= value) == most for name, most, value in rule.terms):
                z += rule.weight
        score = 1 / (1 + math.exp(-z))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.3) and r.held_out == held[r.doc_id]
