"""Quality scores by a sparse ensemble of rules.

Statistics of each text are Spark expressions. Boosted trees are grown on them
over all labelled rows; each path from a root to a node is a conjunctive rule.
A lasso logistic regression weighs the rules, and those with a weight are
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import boxed, cut

SPACES = r"[\x20\x09-\x0D]+"
SEED = 42
TREES, DEPTH = 12, 3
#: Strength of the lasso.
LASSO = 0.002
THRESHOLD = 0.3


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns s_*: doubles, never null (an empty or null text has
    no characters, words or lines, and shares of nothing are 0). Columns of docs
    of those names are replaced, others stay; repeated rows have equal statistics."""
    df = boxed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", SPACES, -1), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x != ""))
    many = lambda pattern: F.char_length("_t") - F.char_length(F.regexp_replace("_t", pattern, ""))
    n, w, lines = F.char_length("_t"), F.size("_w"), F.size("_l")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    letters = F.char_length("_w0")
    df = df.withColumn("_w0", F.array_join("_w", ""))
    stats = {
        "s_chars": n,
        "s_words": w,
        "s_lines": lines,
        "s_word_length": share(letters, w),
        "s_longest_word": F.coalesce(F.array_max(F.transform("_w", F.char_length)), F.lit(0)),
        "s_distinct_words": share(F.size(F.array_distinct("_w")), w),
        "s_distinct_lines": share(F.size(F.array_distinct("_l")), lines),
        "s_words_per_line": share(w, lines),
        "s_upper": share(many("[A-Z]"), letters),
        "s_digits": share(many("[0-9]"), letters),
        "s_stops": share(many(r"[.,;:]"), letters),
        "s_marks": share(many(r"[!-+/<-@\[-`{-~-]"), letters),
        "s_doubles": share(F.regexp_count("_t", F.lit(r"(?<=[\x20\n])(\S++)[\x20\n]\1(?=[\x20\n])")), w),
    }
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in stats]
    return df.select(*own, *[v.cast("double").alias(k) for k, v in stats.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, value), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, most, value in self.terms:
            out = out & (F.col(name) <= value if most else F.col(name) > value)
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1, over the columns of statistics()."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _paths(node, names: list[str], terms: tuple = ()) -> list[tuple]:
    """The conjunctions that lead to each node below a root (a JVM tree node)."""
    out = [terms] if terms else []
    if node.subtreeDepth() > 0:
        name, value = names[node.split().featureIndex()], node.split().threshold()
        for most, child in ((True, node.leftChild()), (False, node.rightChild())):
            # of several bounds of a kind on one statistic, the last is the tightest
            rest = tuple(t for t in terms if t[:2] != (name, most))
            out += _paths(child, names, (*rest, (name, most, value)))
    return out


def fitted(labelled: DataFrame, label: str = "label") -> Model:
    """A model from statistics (s_*) and a label of 0 or 1; rows with a null label are left out.

    With rows of one label only, the score is the smoothed share of 1; without
    rows it is 0.5.
    """
    rows = labelled.where(F.col(label).isNotNull())
    names = sorted(c for c in rows.columns if c.startswith("s_"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    if ones in (0, n):
        return Model((), math.log(prior / (1 - prior)))
    table = cut(VectorAssembler(inputCols=names, outputCol="features").transform(rows.select(*names, F.col(label).cast("double").alias("label"))))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, cacheNodeIds=False, minInstancesPerNode=10).fit(table.select("features", "label"))
    roots = [t._java_obj.rootNode() for t in trees.trees]
    rules = [Rule(t) for t in dict.fromkeys(p for r in roots for p in _paths(r, names))]
    if not rules:
        return Model((), math.log(prior / (1 - prior)))
    met = cut(table.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]))
    met = cut(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(met).select("features", "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(met)
    weights = lasso.coefficients.toArray().tolist()
    return Model(tuple(Rule(r.terms, w) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def scored(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """stats with score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on)."""
    return stats.withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
