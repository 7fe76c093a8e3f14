"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on statistics of labelled texts; every path
from a root is a rule, a conjunction of thresholds. A logistic regression with a
lasso penalty weighs the rules and leaves most out. The rules that remain are
compiled into one column expression, so scoring is a plain projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgraph.llm.text import words_column
from contactgraph.session import cut_lineage

#: Bound of the training sample, for each label.
SAMPLE = 10_000
TREES, DEPTH, LEAST_ROWS = 24, 3, 5
#: Strength of the lasso.
PENALTY = 0.002
SEED = 11


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _matched(text: Column, pattern: str) -> Column:
    """Code points that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _free(name: str, columns: list[str]) -> str:
    """``name``, with as many marks before it as keep it apart from ``columns``."""
    while any(c.startswith(name) for c in columns):
        name = f"_{name}"
    return name


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the statistics of each whole text, and the column of each by
    its name; the columns that ``docs`` has stay as they are. Null texts count as
    empty; shares of nothing are 0."""
    own = _free("_stat_", docs.columns)
    at, listed, by_line = (f"{own}{name}" for name in ("text", "words", "lines"))
    counted = docs.withColumn(at, F.coalesce(F.col(text_col), F.lit(""))).withColumns(
        {listed: words_column(at), by_line: F.split(at, "\n")}
    )
    text = F.col(at)
    n, words = F.length(text), F.size(listed)
    found = {
        "log_chars": F.log1p(n),
        "word_length": _share(n - words, words),
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform(listed, F.length)), F.lit(0))),
        "distinct_words": _share(F.size(F.array_distinct(listed)), words),
        "distinct_lines": _share(F.size(F.array_distinct(by_line)), F.size(by_line)),
        "letters": _share(_matched(text, r"\p{L}+"), n),
        "capitals": _share(_matched(text, r"\p{Lu}+"), n),
        "digits": _share(_matched(text, r"\p{N}+"), n),
        "symbols": _share(_matched(text, r"[^\p{L}\p{N}\s]+"), n),
        "symbol_runs": _share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")), words),
        "lone_symbols": _share(F.regexp_count(text, F.lit(r"(?<=\s)[^\p{L}\p{N}\s](?=\s)")), words),
        "sentences": _share(F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")), words),
    }
    typed = {f"{own}{name}": column.cast("double") for name, column in found.items()}
    return counted.withColumns(typed).drop(at, listed, by_line), {name: f"{own}{name}" for name in found}


@dataclass(frozen=True)
class Rule:
    """Statistics with the side and the threshold each has to keep."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self, columns: dict[str, str]) -> Column:
        kept = F.lit(True)
        for name, side, threshold in self.terms:
            value = F.col(columns[name])
            term = value <= threshold if side == "<=" else value > threshold
            kept = kept & term
        return kept


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and the intercept of the log-odds."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, columns: dict[str, str]) -> Column:
        """The probability of label 1, over columns of :func:`statistics`."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(rule.column(columns), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def rules_of(tree: str, names: list[str]) -> set[Rule]:
    """All paths of a tree, from its printed form: one rule for each node below
    the root. On a path only the tightest threshold of each side stays."""
    found, path = set(), []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        tight: dict[tuple[str, str], float] = {}
        for _, name, side, threshold in path:
            keep = min if side == "<=" else max
            tight[name, side] = keep(tight.get((name, side), threshold), threshold)
        found.add(Rule(tuple(sorted((n, s, t) for (n, s), t in tight.items()))))
    return found


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row's label is kept from training; a null id is not held out."""
    code = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(modulus)) == remainder, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, penalty: float = PENALTY
) -> Ensemble:
    """Grow and weigh rules on labelled documents that are not held out.

    ``labels`` has ``doc_id`` and the label; rows without both count for nothing.
    Of each label at most ``sample`` ids, the first in hash order, are taken, each
    with one text, and each stands for as many as the label has for one taken, so that the scores
    keep to the ratio of all labels.
    With one label only, or none, the score is the smoothed share of label 1.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = [max(1.0, totals.get(float(y), 0) / sample) for y in (0, 1)]
    by_hash = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    parts = [usable.filter(F.col("label") == y).orderBy(*by_hash).limit(sample) for y in (0, 1)]
    # bounded by twice the sample
    chosen = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows, columns = statistics(texts)
    names = list(columns)
    # an id that many rows share has one text in the sample, and the bound holds; no text is shuffled
    measured = F.struct(F.xxhash64("text").alias("hash"), *[F.col(columns[n]).alias(n) for n in names])
    one = rows.select("doc_id", "label", measured.alias("least")).groupBy("doc_id", "label").agg(F.min("least").alias("least"))
    rows = one.select("label", *[F.col("least")[n].alias(n) for n in names])
    rows = cut_lineage(rows.repartition(8, *names).sortWithinPartitions("label", *names))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = weights[1] * counts.get(1.0, 0), weights[0] * counts.get(0.0, 0)
    base = math.log((ones + 1) / (zeros + 1))
    if not ones or not zeros:
        return Ensemble(base, ())

    rows = rows.withColumn("_weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird", seed=SEED,
        weightCol="_weight",
    ).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    rules = sorted(set().union(*[rules_of(t.toDebugString, names) for t in forest.trees]), key=lambda r: r.terms)
    if not rules:
        return Ensemble(base, ())
    marks = rows.select("label", "_weight", *[r.column({n: n for n in names}).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    marked = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marks)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False, weightCol="_weight").fit(
        cut_lineage(marked.select("label", "_weight", "features"))
    )
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6]
    return Ensemble(float(lasso.intercept), tuple(kept))


def score(docs: DataFrame, ensemble: Ensemble, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, by its whole texts; a column of that
    name is replaced. Null texts count as empty, which have statistics like any
    other text. Repeated rows come back as often as they came; nothing is shuffled."""
    rows, columns = statistics(docs, text_col)
    return rows.withColumn("score", ensemble.score(columns)).drop(*columns.values())
