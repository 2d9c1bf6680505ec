"""Classifier metrics, operating points and confounds. A zero denominator gives 0, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import ratio, wilson
from floorline.operators.ranking import running


def confusion_counts(y: Column, pred: Column) -> list[Column]:
    yes = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [
        F.count("*").alias("n"),
        yes((y == 1) & (pred == 1)).alias("tp"),
        yes((y == 1) & (pred == 0)).alias("fn"),
        yes((y == 0) & (pred == 1)).alias("fp"),
        yes((y == 0) & (pred == 0)).alias("tn"),
    ]


def rates() -> list[Column]:
    """Rates from n, tp, fn, fp, tn; both conventions of the false rates."""
    c = F.col
    return [
        ratio(c("tp") + c("tn"), c("n")).alias("acc"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        ratio(c("fp"), c("n")).alias("fp_per_n"),
        ratio(c("fn"), c("n")).alias("fn_per_n"),
        ratio(c("fp"), c("fp") + c("tn")).alias("fpr_std"),
        ratio(c("fn"), c("fn") + c("tp")).alias("fnr_std"),
        ratio(F.greatest(c("tp") + c("fn"), c("fp") + c("tn")), c("n")).alias("majority"),
    ]


def confusion(rows: DataFrame, y: Column, pred: Column, *by: str) -> DataFrame:
    """Counts and rates per group."""
    counted = rows.groupBy(*by).agg(*confusion_counts(y, pred))
    return counted.select("*", *rates())


def auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """n_pos, n_neg, auc: the share of (positive, negative) pairs that the score orders, ties by half; 0 for one class.

    Labels are counted per score, and only counts are summed in order of the score.
    """
    at = rows.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    twice = running(at, score, ["neg"]).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.coalesce(F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))), F.lit(0)).alias("twice"),
    )
    return twice.select("n_pos", "n_neg", ratio(F.col("twice"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def sweep(rows: DataFrame, y: str, score: str, grid: list[int], denominator: int) -> DataFrame:
    """t and the confusion at score > t for every threshold t = g / denominator.

    Rows are first counted by how many thresholds they exceed, so the table is read once and
    nothing is multiplied by the grid but these counts.
    """
    ts = [g / denominator for g in sorted(grid)]
    over = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: F.col(score) > t))
    counted = rows.groupBy(over.alias("over")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    each = counted.select("over", "pos", "neg", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("i", "t"))
    yes = F.col("over") > F.col("i")
    total = lambda keep, what: F.sum(F.when(keep, F.col(what)).otherwise(0))
    out = each.groupBy("t").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), total(yes, "pos").alias("tp"), total(~yes, "pos").alias("fn"), total(yes, "neg").alias("fp"), total(~yes, "neg").alias("tn")
    )
    return out.select("*", *rates())


def operating_points(dev: DataFrame, test: DataFrame, most_fpr: float = 0.10, fallback: float = 0.99) -> DataFrame:
    """Two sweeps joined at chosen thresholds: the first most accurate on dev, and the least with fpr_std within most_fpr."""
    chosen = dev.agg(
        F.min(F.struct((-F.col("acc")).alias("a"), F.col("t"))).getField("t").alias("best"),
        F.coalesce(F.min(F.when(F.col("fpr_std") <= most_fpr, F.col("t"))), F.lit(fallback)).alias("tight"),
    )
    points = chosen.select(F.explode(F.array(F.struct(F.lit("best_accuracy").alias("point"), F.col("best").alias("t")), F.struct(F.lit("low_fpr").alias("point"), F.col("tight").alias("t")))).alias("p")).select("p.*")
    seen = lambda s, name: s.select("t", F.col("acc").alias(f"{name}_acc"), F.col("fpr_std").alias(f"{name}_fpr"), F.col("fnr_std").alias(f"{name}_fnr"))
    return points.join(seen(dev, "dev"), "t").join(seen(test, "test"), "t")


def subset_metrics(rows: DataFrame, y: str, pred: str, sets: list[list[str]]) -> DataFrame:
    """Accuracy against each subset's own majority, for several groupings in one pass (null: all)."""
    names = sorted({c for s in sets for c in s})
    counted = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.count("*").alias("n"), F.sum((F.col(y) == F.col(pred)).cast("long")).alias("k"), F.sum(F.col(y).cast("long")).alias("pos")
    )
    major = F.greatest(F.col("pos"), F.col("n") - F.col("pos"))
    return counted.select(*names, "n", ratio(F.col("k"), F.col("n")).alias("acc"), ratio(major, F.col("n")).alias("majority"), ratio(F.col("k") - major, F.col("n")).alias("delta"))


def smd(rows: DataFrame, y: str, features: list[str]) -> DataFrame:
    """feature, smd: difference of class means over the pooled population deviation."""
    stats = []
    for f in features:
        for c in (0, 1):
            x = F.when(F.col(y) == c, F.col(f).cast("double"))
            stats += [F.avg(x).alias(f"{f}_m{c}"), F.var_pop(x).alias(f"{f}_v{c}")]
    one = rows.agg(*stats)
    pooled = lambda f: (F.col(f"{f}_m1") - F.col(f"{f}_m0")) / (F.sqrt((F.col(f"{f}_v1") + F.col(f"{f}_v0")) / 2) + 1e-12)
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), pooled(f).alias("smd")) for f in features])).alias("r")).select("r.*")


def capacity_gap(rows: DataFrame, y: str, p: str, split: str, threshold: float = 0.5) -> DataFrame:
    """train_acc, dev_acc, gap: how much better a model does on what it was fitted on."""
    right = (F.col(p) > threshold).cast("int") == F.col(y)
    of = lambda s: ratio(F.count_if((F.col(split) == s) & right), F.count_if(F.col(split) == s))
    return rows.agg(of("train").alias("train_acc"), of("dev").alias("dev_acc")).withColumn("gap", F.col("train_acc") - F.col("dev_acc"))


def leakage(rows: DataFrame, group: str, split: str, key: str) -> DataFrame:
    """Groups in more than one split, and how many rows repeat a key."""
    groups = rows.groupBy(group).agg(F.count_distinct(split).alias("s")).agg(F.count("*").alias("groups"), F.count_if(F.col("s") > 1).alias("leaking"))
    keys = rows.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    return groups.crossJoin(keys)  # one row each


def accuracy_interval(rows: DataFrame, right: Column, *by: str) -> DataFrame:
    """n, k, share and its Wilson interval per group."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return counted.select("*", ratio(F.col("k"), F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bucket, low, n, share over [lo, hi) edges; the last bucket is open above, values under the first edge fall out."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    bucket = F.size(F.filter(e, lambda x: F.col(value) >= x)) - 1
    counted = rows.select(bucket.alias("bucket")).where("bucket >= 0").groupBy("bucket").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(F.broadcast(counted), "bucket", "left").select("bucket", F.get(e, F.col("bucket")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a bucket
    return out.withColumn("share", ratio(F.col("n"), total))


def best_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the best value and its gain over the key before (a sweep has few keys)."""
    best = rows.groupBy(key).agg(F.max(value).alias("best"))
    return best.withColumn("gain", F.col("best") - F.lag("best").over(Window.partitionBy(F.lit(0)).orderBy(key)))
