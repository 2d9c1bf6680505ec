"""Replays of labelled boundaries through a live detector: coverage, paired accuracy, and where it was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floorline.functions.exprs import ratio
from floorline.operators import ranking
from floorline.operators.asof import asof

EARLY_MS = 50
#: Legs of a call whose lengths differ by more are mismatched; a detector's buffer; a buffer under this is short.
MISMATCH_MS, BUFFER_MS, SHORT_MS = 50, 8000, 7900


def first_close(boundaries: DataFrame, closes: DataFrame) -> DataFrame:
    """boundaries (leg, t_ms) with `asked_ms`: the first close of speech from 50 ms before the offset on; null if none."""
    probes = boundaries.withColumn("from_ms", F.col("t_ms") - EARLY_MS)
    known = closes.select("leg", F.col("t_ms").alias("close_ms"), F.struct(F.col("t_ms").alias("close_ms")).alias("close"))
    found = asof(probes, known, ["leg"], "from_ms", "close_ms", "close", forward=True)
    return found.withColumn("asked_ms", F.col("close.close_ms")).drop("close", "from_ms")


def coverage(rows: DataFrame, asked: str, *by: str) -> DataFrame:
    """Per group how many rows the detector was asked about."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(asked).alias("asked"))
    return counted.withColumn("share", ratio(F.col("asked"), F.col("n")))


def paired_accuracy(rows: DataFrame, y: str, live: str, offline: str, threshold: float) -> DataFrame:
    """Both ways of scoring on the rows that have both, and their difference."""
    right = lambda p: F.count_if((F.col(p) > threshold).cast("int") == F.col(y))
    one = rows.where(F.col(live).isNotNull() & F.col(offline).isNotNull()).agg(F.count("*").alias("n"), right(live).alias("live_k"), right(offline).alias("offline_k"))
    share = lambda k: ratio(F.col(k), F.col("n"))
    return one.select("n", share("live_k").alias("live_acc"), share("offline_k").alias("offline_acc"), ratio(F.col("live_k") - F.col("offline_k"), F.col("n")).alias("delta"))


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group the values at n // 10, n // 2 and 9 n // 10 of the sorted list."""
    n = F.col("n")
    ranks = {"p10": F.floor(n / 10), "p50": F.floor(n / 2), "p90": F.least(F.floor(9 * n / 10), n - 1)}
    return ranking.at_ranks(rows, list(by), value, ranks)


def manifest(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Per call with both legs: recorded length and leg mismatch, segments and speech per side, end of speech, balance.

    segments: base, side, start_ms, end_ms; durations: base, side, wav_ms.
    """
    side: list[Column] = []
    for s in ("Left", "Right"):
        mine = F.col("side") == s
        side += [F.count_if(mine).alias(f"{s.lower()}_segments"), F.coalesce(F.sum(F.when(mine, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias(f"{s.lower()}_ms")]
    calls = segments.groupBy("base").agg(*side, F.max("end_ms").alias("span_ms"))
    recorded = durations.groupBy("base").agg(F.count_distinct("side").alias("legs"), F.max("wav_ms").alias("wav_ms"), (F.max("wav_ms") - F.min("wav_ms")).alias("mismatch_ms"))
    rows = calls.join(recorded.where("legs = 2").drop("legs"), "base").where("left_segments > 0 and right_segments > 0")
    low, high = F.least("left_ms", "right_ms"), F.greatest("left_ms", "right_ms")
    return rows.withColumn("balance", F.when(high > 0, low / high).otherwise(0.0))


def balance(calls: DataFrame) -> DataFrame:
    """One row about a manifest: recorded and spoken hours, segments, mismatched calls, balance of the legs."""
    n = F.col("n")
    ranks = ranking.at_ranks(calls, [], "balance", {"balance_p10": F.floor(n / 10), "balance_p50": F.floor(n / 2)}).drop("n")
    total = calls.agg(
        F.count("*").alias("calls"),
        F.sum("wav_ms").alias("wav_ms"),
        F.sum(F.col("left_ms") + F.col("right_ms")).alias("speech_ms"),
        F.sum(F.col("left_segments") + F.col("right_segments")).alias("segments"),
        F.count_if(F.col("mismatch_ms") > MISMATCH_MS).alias("mismatched"),
    )
    return total.crossJoin(F.broadcast(ranks))  # a row each


def buffered(asked: DataFrame, cleared: DataFrame, most_ms: int = BUFFER_MS) -> DataFrame:
    """asked (leg, asked_ms) with `fill_ms`: the sound in a rolling buffer that every turn boundary (leg, t_ms) clears."""
    known = cleared.select("leg", F.col("t_ms").alias("clear_ms"), F.struct(F.col("t_ms").alias("at")).alias("clear"))
    found = asof(asked.where("asked_ms is not null"), known, ["leg"], "asked_ms", "clear_ms", "clear")
    since = F.col("asked_ms") - F.coalesce(F.col("clear.at"), F.lit(0))
    return found.withColumn("fill_ms", F.least(F.lit(most_ms).cast("long"), since)).drop("clear")


def probe(rows: DataFrame, y: str, features: list[str], test: Column, seed: int = 0) -> DataFrame:
    """n_pos, n_neg, auc of a logistic regression on standardised features, fitted outside `test`, and a verdict on shortcuts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from floorline.operators.metrics import auc

    packed = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows.withColumn("__test", test))
    train = packed.where(~F.col("__test"))
    scaler = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="__z", labelCol=y, regParam=1.0 / max(1, train.count())).fit(scaler.transform(train))
    scored = model.transform(scaler.transform(packed.where("__test"))).select(F.col(y).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    found = auc(scored, "y", "p")
    return found.withColumn("verdict", F.when(F.col("auc") < 0.65, "clean").when(F.col("auc") < 0.80, "suspicious").otherwise("leaking"))
