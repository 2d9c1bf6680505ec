import random

from pyspark.sql import functions as F

from floorline.operators import calllog as cl, labels as lb, metrics as mt, ranking, sampling as sp


def test_published_confusion_rates(spark):
    rows = [(1, 1)] * 2428 + [(1, 0)] * 201 + [(0, 1)] * 373 + [(0, 0)] * 1166
    r = mt.confusion(spark.createDataFrame(rows, "y int, p int"), F.col("y"), F.col("p")).first()
    assert round(100 * r.acc, 2) == 86.23 and round(100 * r.fp_per_n, 2) == 8.95 and round(100 * r.majority, 2) == 63.08
    assert (r.tp, r.fn, r.fp, r.tn) == (2428, 201, 373, 1166)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "y int, p double")
    r = mt.confusion(none, F.col("y"), (F.col("p") > 0.5).cast("int")).first()
    assert (r.n, r.acc, r.precision, r.f1) == (0, 0.0, 0.0, 0.0)
    assert mt.auc(none, "y", "p").first().auc == 0.0
    one = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, p double")
    assert mt.auc(one, "y", "p").first().auc == 0.0


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 30) / 30) for _ in range(800)]
    got = mt.auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert (got.n_pos, got.n_neg) == (len(pos), len(neg)) and abs(got.auc - want) < 1e-12


def test_sweep_is_strict(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.51)], "y int, p double")
    got = {r.t: (r.tp, r.fn, r.fp, r.tn) for r in mt.sweep(rows, "y", "p", [49, 50, 51], 100).collect()}
    assert got == {0.49: (2, 0, 1, 0), 0.5: (1, 1, 0, 1), 0.51: (0, 2, 0, 1)}


def test_ranks_and_quantiles(spark):
    rng = random.Random(9)
    groups = {g: [rng.choice([rng.random(), 0.5]) for _ in range(n)] for g, n in (("a", 1), ("b", 7), ("c", 500))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    ranks = {"f": ranking.rank_floor(0.9), "n": ranking.rank_nth(10), "r": ranking.rank_nearest(95)}
    ranks["nth"] = ranks.pop("n")
    for r in ranking.at_ranks(df, ["g"], "v", ranks).collect():
        s = sorted(groups[r.g])
        assert r.f == s[min(int(0.9 * len(s)), len(s) - 1)] and r.nth == s[len(s) // 10] and r.r == s[min(len(s) - 1, round(0.95 * (len(s) - 1)))]
    places = {r.k: r.ordinal for r in ranking.ordinal(spark.range(3000).select(F.col("id").alias("k")), "k").collect()}
    assert [k for k, _ in sorted(places.items(), key=lambda x: x[1])] == sorted(range(3000), key=str)


def test_running_sums(spark):
    df = spark.createDataFrame([(v, v % 7) for v in range(500)], "v long, n long")
    for r in ranking.running(df, "v", ["n"]).collect():
        assert r.n_before == sum(x % 7 for x in range(r.v))


def test_verdicts(spark):
    replies = ['```json\n{"verdict":" Complete","confidence":0.9,"reason":"a\\n b"}\n```', '[{"verdict":"incomplete"}]', "[{},{}]", "", None, "{broken", '{"verdict":"maybe"}']
    got = [tuple(r.v) for r in spark.createDataFrame([(r,) for r in replies], "t string").select(lb.parse_verdict(F.col("t")).alias("v")).collect()]
    assert got[0] == ("complete", 0.9, "a b") and got[1] == ("incomplete", 0.0, "")
    assert [v[0] for v in got[2:]] == ["error"] * 5
    human = spark.createDataFrame([("Complete ",), ("Unsure",), (None,)], "t string").select(lb.verdict_text(F.col("t")).alias("v"))
    assert [r.v for r in human.collect()] == ["complete", None, None]


def test_policies(spark):
    rows = spark.createDataFrame([("a", 1, "change"), ("b", 0, "hold_intra"), ("c", 1, "change")], "sid string, label_rule int, source string")
    said = spark.createDataFrame([("a", "incomplete", 0.9), ("b", "complete", 0.8), ("c", "error", 0.0)], "sid string, verdict string, confidence double")
    take = lambda policy: {r.sid: (r.label_final, r.dispute, r.llm_ok) for r in lb.relabel(rows, said, policy).collect()}
    assert take("llm") == {"a": (0, True, True), "b": (1, True, True), "c": (1, False, False)}
    assert take("core-safe") == {"a": (1, True, True), "b": (1, True, True), "c": (1, False, False)}


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    assert {r.k: r.v for r in lb.last_wins(rows, ["k"], ["at"]).collect()} == {"a": "y", "b": None}


def test_split_numbers_and_disjointness(spark):
    groups = spark.createDataFrame([(f"c{i:03d}", 1000 - i) for i in range(116)], "call string, n long")
    got = sp.group_split(groups, "call", "n", 30, 16, 1).collect()
    counts = {s: sum(r.split == s for r in got) for s in ("train", "dev", "test")}
    assert counts == {"train": 71, "dev": 15, "test": 30} and len({r.call for r in got}) == 116
    again = sp.group_split(groups.repartition(7), "call", "n", 30, 16, 1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 5).alias("s"))
    for f in (lambda d: sp.stratified_draw(d, ["s"], "id", 50, 3), lambda d: sp.fraction_sample(d, ["s"], "id", 0.13, 3), lambda d: sp.stride_sample(d, "id", 8), lambda d: sp.evenly_spaced(d, "id", 11)):
        first = sorted(map(tuple, f(rows).collect()))
        assert first == sorted(map(tuple, f(rows.repartition(9)).collect())) and first
    assert sp.fraction_sample(rows, ["s"], "id", 0.13, 3).groupBy("s").count().select("count").distinct().collect()[0][0] == 13


def log(spark, rows):
    names = [c.split(" ")[0] for c in cl.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], cl.SCHEMA)


def test_call_log(spark):
    user = lambda t, call="a", **x: {"call": call, "kind": "transcript", "role": "user", "source": "item", "t_ms": t, "seq": t} | x
    agent = lambda t, call="a", **x: {"call": call, "kind": "metric", "role": "assistant", "t_ms": t, "seq": t, "started_at_ms": 5000 + t} | x
    meta = {"call": "a", "kind": "meta", "t0_ms": 5000, "t_ms": 0, "arm": ""}
    rows = [meta, user(100), user(200), agent(200, e2e_ms=7), user(300), agent(20_000, e2e_ms=9), user(30_000), {"call": "b", "kind": "prediction", "t_ms": 4, "probability": 0.4, "threshold": 0.5}]
    d = log(spark, rows)
    assert {r.call: (r.arm, r.duration_ms) for r in cl.calls(d).collect()} == {"a": ("baseline", 30_000), "b": ("detector", 4)}
    frag = cl.fragmentation(d).first()
    assert (frag.turns, frag.blocks) == (4, 3)  # at 200 the agent comes before the user
    air = {r.call: r for r in cl.dead_air(d).collect()}
    assert (air["a"].committed, air["a"].replies, air["a"].answered, air["a"].longest_ms, air["a"].long_waits) == (4, 2, 3, 100, 0)  # 300 is within half a second of the start at 200
    lat = {r.stage: (r.n, r.p50_ms) for r in cl.latency(d).collect()}
    assert lat == {"total": (2, 7)}
