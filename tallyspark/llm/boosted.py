"""Gradient-boosted trees trained by Spark's own library and applied as one column expression."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BoostedTrees:
    """The trees of a trained model, each a nested (feature, threshold, left, right) or a leaf value."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights = trees, weights

    def probability(self, feature) -> Column:
        """The probability of label 1; ``feature(i)`` gives the column of the i-th feature."""
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            i, threshold, left, right = node
            return F.when(feature(i) <= threshold, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(weight) * walk(tree)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _parse(lines: list[str]):
    """The tree that begins at the front of ``lines`` (the model's own description), which it uses up."""
    line = lines.pop(0)
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _parse(lines)
    lines.pop(0)  # the Else line
    return int(feature), float(threshold), left, _parse(lines)


def train(rows: DataFrame, rounds: int = 12, depth: int = 3, parts: int = 4, weight: str | None = None) -> BoostedTrees | None:
    """Trees from ``rows`` (x: array of doubles, label 0 or 1), ``weight`` examples each; None without both labels."""
    have = [r.label for r in rows.select("label").distinct().limit(3).collect()]
    if len(have) < 2:
        return None
    data = rows.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"),
                       (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, weightCol="weight").fit(data.coalesce(parts))
    lines = [x.strip() for x in model.toDebugString.splitlines()[1:]]
    trees = []
    while lines:
        line = lines.pop(0)
        if line.startswith("Tree"):
            trees.append(_parse(lines))
    return BoostedTrees(trees, list(model.treeWeights))
