"""Multi-step recursion of a fitted model as a fold inside one expression per series.

A loop of one-step jobs would grow the plan with the horizon. Coefficients travel in the plan; the nodes of boosted trees are
a stored table of one row, read by a scalar subquery, so that the plan does not grow with the trees. Every series runs all its
steps in one task without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import workspace, written

NODE_COLUMN = "_nodes"

Predictor = Callable[[Column], Column]

NODES = "f array<int>, t array<double>, l array<int>, r array<int>, v array<double>, roots array<int>"


def linear_predictor(model: LinearRegressionModel) -> Predictor:
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])

    def predict(x: Column) -> Column:
        products = F.zip_with(x, weights, lambda a, b: a * b)
        return F.aggregate(products, F.lit(float(model.intercept)), lambda acc, v: acc + v)

    return predict


def tree_predictor(model: Model, df: DataFrame) -> tuple[Predictor, Column]:
    """Weighted sum over the trees; each walks from its root to a leaf by table look-ups in the column
    ``NODE_COLUMN``, whose value comes second.

    The node table is read from the stored model and is bounded by trees x 2^(depth + 1).
    A leaf points to itself, so that every tree can take the same number of moves.
    """
    spark = df.sparkSession
    path = workspace(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    rows = sorted(stored.collect(), key=lambda r: (r.treeID, r.id))
    place = {(r.treeID, r.id): i for i, r in enumerate(rows)}
    weights = model.treeWeights
    leaf = [r.leftChild < 0 for r in rows]
    table = (
        [0 if end else r.featureIndex for r, end in zip(rows, leaf)], [0.0 if end else r.threshold for r, end in zip(rows, leaf)],
        [i if end else place[r.treeID, r.leftChild] for i, (r, end) in enumerate(zip(rows, leaf))],
        [i if end else place[r.treeID, r.rightChild] for i, (r, end) in enumerate(zip(rows, leaf))],
        [r.prediction * weights[r.treeID] for r in rows], [place[t, 0] for t in range(len(weights))],
    )
    nodes = written(spark.createDataFrame([table], NODES), "nodes").select(F.struct("*")).scalar()
    moves = F.sequence(F.lit(1), F.lit(model.getOrDefault("maxDepth")))

    def predict(x: Column) -> Column:
        n = F.col(NODE_COLUMN)

        def move(at: Column, _: Column) -> Column:
            return F.when(x[n["f"][at]] <= n["t"][at], n["l"][at]).otherwise(n["r"][at])

        return F.aggregate(n["roots"], F.lit(0.0), lambda acc, root: acc + n["v"][F.aggregate(moves, root, move)])

    return predict, nodes


def roll_forward(model: Model, state: DataFrame, steps: int | Column, features: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """Predict, drop the oldest value, append the prediction, repeat.

    ``state`` carries ``window``; the result gains ``path`` with one prediction per step.
    ``steps`` may be a column, for a horizon of each series of its own.
    """
    ready = state
    if isinstance(model, LinearRegressionModel):
        predict = linear_predictor(model)
    else:
        predict, nodes = tree_predictor(model, state)
        ready = state.withColumn(NODE_COLUMN, nodes)
    until = F.lit(steps) if isinstance(steps, int) else steps
    start = F.struct(F.col("window").alias("w"), F.expr("cast(array() as array<double>)").alias("out"))

    def advance(s: Column, _: Column) -> Column:
        # Single-item transforms name a value so that it is computed once.
        step = F.transform(F.transform(F.array(features(s["w"])), predict), lambda y: F.struct(
            F.concat(F.slice(s["w"], 2, F.size(s["w"]) - 1), F.array(y)).alias("w"),
            F.concat(s["out"], F.array(y)).alias("out"),
        ))
        return step[0]

    walk = F.aggregate(F.sequence(F.lit(1), until.cast("int")), start, advance, lambda s: s["out"])
    return ready.withColumn("path", F.when(until > 0, walk).otherwise(F.expr("cast(array() as array<double>)"))).drop(NODE_COLUMN)
