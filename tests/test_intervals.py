"""Windows against plain restatements, and the traps of equality and order."""

import random

import pytest
from pyspark.sql import functions as F

from floorline.functions import exprs
from floorline.operators import asof, intervals
from floorline.operators.intervals import Decoder
from floorline.streaming.frames import advance

SPANS = "base string, side string, start_ms long, end_ms long"


def decode(ps, d=Decoder()):
    state, out = (0, 0, 0, 0), []
    for i, p in enumerate(ps):
        state, closed = advance(state, i, p, d)
        if closed:
            out.append(closed)
    if state[0]:
        out.append((state[1], len(ps)))
    return [(a * 32, b * 32) for a, b in out if b - a >= d.speech_frames]


def test_hysteresis_equals_state_machine(spark):
    rng = random.Random(4)
    legs = {f"l{k}": [rng.choice([0.1, 0.34, 0.35, 0.4, 0.49, 0.5, 0.9]) for _ in range(rng.randint(0, 60))] for k in range(120)}
    legs |= {"open": [0.9] * 5, "silent": [0.0] * 9, "dip": [0.9, 0.9, 0.1, 0.9, 0.9], "three": [0.9] * 4 + [0.1] * 3 + [0.9] * 3}
    rows = [(leg, i, p) for leg, ps in legs.items() for i, p in enumerate(ps)]
    got = intervals.hysteresis(spark.createDataFrame(rows, "leg string, i long, p double")).collect()
    want = sorted((leg, a, b) for leg, ps in legs.items() for a, b in decode(ps))
    assert sorted(tuple(r) for r in got) == want


def test_hysteresis_needs_ordered_thresholds():
    with pytest.raises(ValueError):
        Decoder(on=0.3, off=0.4)


def test_asof_strictness(spark):
    table = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y")], "k string, t long, v string").withColumn("take", F.struct("v"))
    probes = spark.createDataFrame([("a", 9), ("a", 10), ("a", 15), ("a", 20), ("a", 21), ("b", 10)], "k string, at long")

    def found(**how):
        return {(r.k, r.at): r.take.v if r.take else None for r in asof.asof(probes, table, ["k"], "at", "t", "take", **how).collect()}

    assert found() == {("a", 9): None, ("a", 10): "x", ("a", 15): "x", ("a", 20): "y", ("a", 21): "y", ("b", 10): None}
    assert found(strict=True)[("a", 10)] is None and found(strict=True)[("a", 20)] == "x"
    assert found(forward=True) == {("a", 9): "x", ("a", 10): "x", ("a", 15): "y", ("a", 20): "y", ("a", 21): None, ("b", 10): None}
    assert found(forward=True, strict=True)[("a", 10)] == "y" and found(forward=True, strict=True)[("a", 20)] is None


def test_lengths_inside_windows(spark):
    rng = random.Random(7)
    spans, at = [], 0
    for _ in range(40):
        a = at + rng.randint(0, 5)
        b = a + rng.randint(1, 9)
        spans.append(("c", "Left", a, b))
        at = b
    windows = [("c", a, a + rng.randint(0, 40)) for a in range(0, 250, 3)]
    w = spark.createDataFrame(windows, "base string, low long, high long")
    got = intervals.length_inside(w, spark.createDataFrame(spans, SPANS), ["base"], "low", "high", "ms").collect()
    for r in got:
        assert r.ms == sum(max(0, min(b, r.high) - max(a, r.low)) for _, _, a, b in spans)


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_overlap_join_buckets(spark, bucket):
    rng = random.Random(8)
    make = lambda n: [("c", a, a + rng.randint(1, 30)) for a in (rng.randint(0, 200) for _ in range(n))]
    left, right = make(30), make(30)
    df = lambda rows: spark.createDataFrame(rows, "base string, start_ms long, end_ms long")
    got = sorted((r.start_ms, r.end_ms, r.r_start_ms, r.r_end_ms, r.overlap_ms) for r in intervals.overlap_join(df(left), df(right), ["base"], bucket).collect())
    want = sorted((a, b, c, d, min(b, d) - max(a, c)) for _, a, b in left for _, c, d in right if a < d and c < b)
    assert got == want


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SPANS)
    assert intervals.simultaneous(none).collect() == []
    assert intervals.totals(none).collect() == []
    assert intervals.hysteresis(spark.createDataFrame([], "leg string, i long, p double")).collect() == []


def test_half_even_and_rates(spark):
    rows = spark.createDataFrame([(5, 2), (7, 2), (9, 2), (1, 3), (2, 3), (0, 5)], "a long, b long")
    got = [r[0] for r in rows.select(exprs.half_even(F.col("a"), F.col("b"))).collect()]
    assert got == [2, 4, 4, 0, 1, 0]


def test_wilson_and_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (14, 3), (5, 5), (1, 0), (600, 500)], "b long, c long")
    p = {(r.b, r.c): r.p for r in rows.withColumn("p", exprs.mcnemar(F.col("b"), F.col("c"))).collect()}
    assert p[(0, 0)] == 1.0 and round(p[(14, 3)], 3) == 0.013 and p[(5, 5)] == 1.0 and p[(1, 0)] == 1.0
    assert 0.001 < p[(600, 500)] < 0.01
    low, high = exprs.wilson(F.col("k"), F.col("n"))
    w = spark.createDataFrame([(0.0, 0.0), (192.0, 197.0)], "k double, n double").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(w[0]) == (0.0, 0.0) and round(w[1].l, 2) == 0.94 and round(w[1].h, 2) == 0.99


def test_sample_id_keeps_long_times(spark):
    row = spark.createDataFrame([("b", "Left", 123456789), ("b", "Right", 5)], "base string, side string, t long")
    assert [r[0] for r in row.select(exprs.sample_id(F.col("base"), F.col("side"), F.col("t"))).collect()] == ["b_L_123456789", "b_R_00000005"]


def test_words_split_unicode_space(spark):
    row = spark.createDataFrame([("a b  c",), ("",), (None,), ("  x ",)], "t string")
    assert [r[0] for r in row.select(exprs.word_count(F.col("t"))).collect()] == [3, 0, 0, 1]
