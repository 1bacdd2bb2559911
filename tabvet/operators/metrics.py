"""Model metrics as aggregates (M4, M5)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.functions.prefix import running_sums


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M4: accuracy and support-weighted precision / recall / F1
    (zero_division = 0). One shuffle to a confusion table; texts are made of
    its few values, not of every row's."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    conf = pairs.groupBy(F.col("y").cast("string").alias("y"), F.col("p").cast("string").alias("p")).agg(F.sum("n").alias("n"))
    support = conf.groupBy("y").agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("predicted"))
    tp = conf.where(F.col("y") == F.col("p")).select("y", F.col("n").alias("tp"))
    per = (support.join(predicted, "y", "full").join(tp, "y", "left")
           .fillna(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.select("support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """M4: exact ROC-AUC (Mann-Whitney with average ranks for ties); null
    unless exactly two classes are present. Scores are pre-aggregated, then
    a bucketed running sum gives negatives-below for every distinct score."""
    per_score = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
                 .groupBy(F.col(score).cast("double").alias("s"))
                 .agg(F.count_if(F.col(label) == F.lit(positive)).alias("pos"),
                      F.count_if(F.col(label) != F.lit(positive)).alias("neg")))
    classes = df.where(F.col(label).isNotNull()).agg(F.count_distinct(label).alias("k"))
    ranked = running_sums(per_score, "s", ["neg"])
    agg = ranked.agg(F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("u"),
                     F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.crossJoin(classes).select(
        F.when((F.col("k") == 2) & (F.col("P") > 0) & (F.col("N") > 0),
               F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def regression_metrics(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """M5: r2, mae, rmse, mse in one pass (SST via the population variance)."""
    err = F.col(y).cast("double") - F.col(y_hat).cast("double")
    a = df.agg(F.sum(err * err).alias("sse"), F.avg(F.abs(err)).alias("mae"),
               F.var_pop(F.col(y).cast("double")).alias("vp"), F.count(F.lit(1)).alias("n"))
    mse = F.col("sse") / F.col("n")
    return a.select(
        F.when(F.col("vp") > 0, 1 - F.col("sse") / (F.col("vp") * F.col("n")))
        .otherwise(F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).alias("r2"),
        "mae", F.sqrt(mse).alias("rmse"), mse.alias("mse"))
