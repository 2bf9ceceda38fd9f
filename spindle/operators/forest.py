"""Random-forest evaluation (M1-M5) with pyspark.ml.

The split is a reproducible hash split (no sampling state); the forest is
``RandomForestClassifier`` (distributed tree induction); the report and the
confusion matrix are two small aggregations over the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, id_col: str, train_fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: deterministic split on ``md5(seed:id)`` -- the same rows on every run, every
    cluster size and every engine that has md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1000))
    cut = int(round(train_fraction * 1000))
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def features(df: DataFrame, cols: Sequence[str] | None = None, array_col: str | None = None,
             out: str = "features") -> DataFrame:
    """Feature vector from numeric columns or from an array column."""
    if array_col is not None:
        return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def fit_forest(train: DataFrame, target: str, num_trees: int = 100, seed: int = 42, features_col: str = "features"):
    """M2: fit a random forest; rows with any null are dropped first."""
    rf = RandomForestClassifier(labelCol=target, featuresCol=features_col, numTrees=num_trees, seed=seed)
    return rf.fit(train.na.drop())


def tree_table(model, path: str) -> DataFrame:
    """The fitted forest as a node table ``tree, node, feature, threshold, left, right, stats``
    (class weights; children of a leaf are null), written to ``path``."""
    model.write().overwrite().save(path)
    from pyspark.sql import SparkSession
    n = SparkSession.getActiveSession().read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return n.select("tree", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
                    F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
                    F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.col("impurityStats").alias("stats"))


def score_by_joins(data: DataFrame, nodes: DataFrame, depth: int, id_col: str = "id", array_col: str = "vec") -> DataFrame:
    """``id, prediction`` from a node table alone: every row goes down every tree by one join a
    level, the class shares of the leaves are added up, the largest (lowest of equal ones) wins."""
    trees = nodes.select("tree").distinct()
    n = trees.count()  # the forest's size
    at = data.select(id_col, F.col(array_col).cast("array<double>").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tree")).withColumn("node", F.lit(0))
    for _ in range(depth):
        down = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(nodes.drop("stats"), ["tree", "node"]).select(id_col, "x", "tree", down.alias("node"))
    votes = at.join(nodes.select("tree", "node", "stats"), ["tree", "node"]).select(
        id_col, F.posexplode(F.transform("stats", lambda v: v / F.aggregate("stats", F.lit(0.0), lambda a, x: a + x))).alias("class", "share"))
    total = votes.groupBy(id_col, "class").agg(F.sum("share").alias("share"))
    best = total.groupBy(id_col).agg(F.max(F.struct(F.round("share", 9).alias("share"), (-F.col("class")).alias("minus"))).alias("b"))
    return best.select(id_col, (-F.col("b.minus")).cast("double").alias("prediction"))


def accuracy(pred: DataFrame, target: str, prediction: str = "prediction") -> float:
    """M3: accuracy."""
    ev = MulticlassClassificationEvaluator(labelCol=target, predictionCol=prediction, metricName="accuracy")
    return ev.evaluate(pred)


def accuracy_df(pred: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    return pred.agg((F.count_if(F.col(target).cast("double") == F.col(prediction).cast("double"))
                     / F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """M4: per class precision, recall, F1 and support (``0.0`` where undefined)."""
    p = pred.select(F.col(target).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
    tp = p.filter(F.col("y") == F.col("p")).groupBy(F.col("y").alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    sup = p.groupBy(F.col("y").alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    prd = p.groupBy(F.col("p").alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    j = sup.join(prd, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec = safe(F.col("tp"), F.col("predicted"))
    rec = safe(F.col("tp"), F.col("support"))
    return j.select("cls", prec.alias("precision"), rec.alias("recall"),
                    safe(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("long").alias("support"))


def confusion(pred: DataFrame, target: str, prediction: str = "prediction", wide: bool = False) -> DataFrame:
    """M5: confusion matrix; long ``(label, prediction, n)`` or pivoted (``wide``)."""
    p = pred.select(F.col(target).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
    if wide:
        return p.groupBy("label").pivot("prediction").count().fillna(0)
    return p.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
