"""Columns of any names go through every operator that returns its input's rows."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, fingerprint, language, mixing, quality, secrets, simhash, urlfilter

LLM = pathlib.Path(decontaminate.__file__).parent
#: Every name in quotes that looks like a column of some step.
INNER = sorted({n for p in LLM.glob("*.py") for n in re.findall(r'"(_[a-z][a-z0-9_]*|id|tag|row|fp|form|bad|bad_tag|clash|found_id|found_tag|score|lang_pred|lang_mix|lang_gain|spans|host|path|rule|verdict|size|target|copies|fingerprint|component_id)"', p.read_text())})
TEXTS = ["the cat sat on the mat and looked at the moon over there", "le chat est assis sur le tapis et regarde la lune là bas", "password = abcdefghijklmnop in a text of some words", None, "", "the cat sat on the mat and looked at the moon over there"]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in [*INNER, "odd name", "a.b"]})


STAGES = {
    "decontaminated": lambda d: decontaminate.decontaminated(d, d.sparkSession.createDataFrame([("i", "looked at the moon over there now and then again")], "item_id string, text string")),
    "redacted": lambda d: secrets.redacted(d),
    "deduplicated": lambda d: simhash.deduplicated(d),
    "accepted": lambda d: language.accepted(d),
    "mixture": lambda d: mixing.mixture(d),
    "fingerprints": lambda d: fingerprint.fingerprints(d),
    "judged": lambda d: urlfilter.judged(d.withColumn("url", F.lit("http://www.example.com/en/x")), d.sparkSession.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")),
    "statistics": lambda d: quality.statistics(d),
}
#: What an operator adds takes the place of a column of that name.
MADE = {"fingerprints": {"fingerprint"}, "judged": {"host", "path", "rule", "verdict"}, "mixture": {"copy_no"}}


@pytest.mark.parametrize("name", STAGES)
def test_columns_of_any_names(docs, name):
    assert len(INNER) > 60
    out = STAGES[name](docs)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        for c in [*INNER, "odd name", "a.b"]:
            if c not in MADE.get(name, ()):
                assert r[c] == f"{c}:{r.doc_id}", c
