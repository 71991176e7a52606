"""Text quality as a sparse ensemble of rules over statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import SPACE, keep, signature_rows

#: Rows the rules are learnt from, at most; the trees and their depth; the strength of the lasso.
SAMPLE_ROWS, TREES, DEPTH, LASSO = 20_000, 24, 3, 0.002


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as column expressions, none of them null; shares are of all characters or of all words."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\\n"), lambda w: w != "")
    chars, count = F.length(text), F.size(F.col("_words"))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")) / F.greatest(chars, F.lit(1))

    per_word = lambda x: x / F.greatest(count, F.lit(1))
    return {"_words": words, "_lines": lines, "log_chars": F.log1p(chars.cast("double")), "log_words": F.log1p(count.cast("double")),
            "upper_share": share("\\p{Lu}"), "digit_share": share("0-9"), "symbol_share": share("#$%&*+/<=>@\\\\^_`{|}~\\[\\]"),
            "stop_share": share(".?!"), "space_share": share("\\x20\\x09-\\x0D"),
            "word_length": per_word(chars.cast("double")), "distinct_words": per_word(F.size(F.array_distinct("_words"))),
            "line_words": count / F.greatest(F.size("_lines"), F.lit(1)),
            "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1))}


NAMES = ["log_chars", "log_words", "upper_share", "digit_share", "symbol_share", "stop_share", "space_share", "word_length",
         "distinct_words", "line_words", "distinct_lines"]


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows(lineage, genes)`` with the statistics in place of the text."""
    exprs = text_statistics(F.col("genes"))
    arrays = rows.withColumns({"_words": exprs["_words"], "_lines": exprs["_lines"]})
    return arrays.select(*[c for c in rows.columns if c != "genes"], *[exprs[n].cast("double").alias(n) for n in NAMES])


@dataclass(frozen=True)
class RuleModel:
    """``intercept`` plus the weights of all rules that hold; a rule is a conjunction of ``(statistic, is_above, threshold)``."""

    intercept: float
    rules: Mapping[tuple[tuple[str, bool, float], ...], float]

    def score(self) -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules.items():
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    parts = [F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at) for name, above, at in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(text: str, names: list[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every path from the root of a printed decision tree to any inner or end node, as a conjunction in a fixed order."""
    rules, path = set(), []
    for line in text.splitlines():
        if m := _SPLIT.match(line):
            depth, (feature, sign, at) = len(m[1]), m.groups()[2:]
            path = [x for x in path if x[0] < depth] + [(depth, (names[int(feature)], sign == ">", float(at)))]
            bounds: dict[tuple[str, bool], float] = {}
            for _, (name, above, value) in path:  # the tighter of two bounds of one kind holds
                old = bounds.get((name, above), value)
                bounds[name, above] = max(old, value) if above else min(old, value)
            rules.add(tuple(sorted((n, a, v) for (n, a), v in bounds.items())))
    return rules


def fit_rules(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
              seed: int = 7) -> RuleModel:
    """Learn rules from ``labelled(lineage, label, <statistics>)``: paths of a random forest, weighted by a lasso logistic regression.

    At most ``sample_rows`` rows are used, those with the smallest hash of their lineage; that bounds the fit whatever the table holds.
    Without rows, or with one label only, there are no rules and the score is the smoothed share of label 1.
    """
    sample = keep(labelled.orderBy(F.xxhash64(F.col("lineage").cast("string"), F.lit(seed)), "lineage").limit(sample_rows).coalesce(1))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleModel(math.log(share / (1 - share)), {})
    vectors = VectorAssembler(inputCols=NAMES, outputCol="_x").transform(sample)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(vectors)
    rules = sorted(set().union(*[tree_rules(t.toDebugString, NAMES) for t in forest.trees]))
    flags = sample.select("label", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flat = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(flags)
    model = LogisticRegression(featuresCol="_x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(flat)
    weights = model.coefficients.toArray().tolist()
    return RuleModel(float(model.intercept), {r: w for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6})


def signature_quality(signatures: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: Sequence[str] = (), **fit: int | float) -> DataFrame:
    """Score the quality of each text of ``signatures(lineage, genes)`` as ``labels(lineage, label)`` marks it.

    The labels given are all learnt from; hold rows back by leaving their labels out. Returns ``lineage, score, predicted``: the
    probability of label 1, and whether it is ``threshold`` or more. Statistics are taken over all whole texts and written; the
    fit reads a bounded sample of them (``sample_rows``), and the rules are scored as one column expression. What ``carry`` names may be as large as
    the texts, so it isn't written: statistics are then taken once more, as the result is read.

    Null text is empty and gets a score like any other. Labels that are null or for unknown lineages are left out; several labels of one
    lineage count each. Repeated rows get equal scores, null lineages a score but no label. Extra columns are left out
    but for those that ``carry`` names.
    """
    stats = keep(with_statistics(signature_rows(signatures)))
    known = labels.filter(F.col("label").isNotNull()).select("lineage", F.col("label").cast("double").alias("label"))
    model = fit_rules(stats.join(known, "lineage"), **fit)
    rows = with_statistics(signature_rows(signatures, *carry)) if carry else stats
    scored = rows.select("lineage", *carry, model.score().alias("score"))
    return scored.select("lineage", *carry, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
