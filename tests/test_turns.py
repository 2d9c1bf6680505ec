"""Boundaries, gates and turns on hand-made calls, and absorption against a sequential restatement."""

import random

from pyspark.sql import functions as F

from floorline.operators import boundaries as bd, checks, gates, transcript, turns as tn

SPANS = "base string, side string, start_ms long, end_ms long, k long, segs array<string>, text string"


def calls(spark, rows):
    full = [(b, s, a, e, k, [f"{s}{a}"] if segs is None else segs, text) for b, s, a, e, k, segs, text in rows]
    return spark.createDataFrame(full, SPANS)


def span(base, side, a, e, k=100, segs=None, text="one two"):
    return (base, side, a, e, k, segs, text)


def test_next_other_is_strictly_after(spark):
    s = calls(spark, [span("c", "Left", 0, 1000), span("c", "Left", 5000, 6000), span("c", "Right", 1000, 1500), span("c", "Right", 2000, 4000)])
    b = bd.boundaries(s).where("side = 'Left'").first()
    assert b.t_ms == 1000 and b.kind == "change" and b.gap_ms == 1000  # the span that starts at t is not next
    assert b.active and b.other_gap_ms == 500  # but it straddles


def test_gate_order_and_funnel(spark):
    rng = random.Random(3)
    rows = []
    for c in range(6):
        for side in ("Left", "Right"):
            at = rng.randint(0, 500)
            for _ in range(60):
                e = at + rng.randint(60, 2500)
                rows.append(span(f"c{c}", side, at, e, rng.randint(0, 99), [f"{side}{at // 6000}"], rng.choice(["", "a b"])))
                at = e + rng.randint(20, 3000)
    judged = gates.judged(bd.boundaries(calls(spark, rows)))
    stages = {r.stage: r.n for r in gates.funnel(judged).collect()}
    ends = {k: v for k, v in stages.items() if k != "total" and not k.startswith("cand_")}
    assert sum(ends.values()) == stages["total"] == len(rows) - 12
    assert "pos_gap_short" not in ends and "other_spoke" not in ends  # cannot happen under these gates
    early = sum(ends.get(k, 0) for k in ("short_prev", "no_text", "straddle", "bargein"))
    assert stages["cand_change"] + stages["cand_hold"] == stages["total"] - early


def absorb(runs):
    """Fixed point by repeated passes over (side, ms, k, members)."""
    changed = True
    while changed:
        changed, merged, i = False, [], 0
        while i < len(runs):
            side, start, end, k, held = runs[i]
            if 0 < i < len(runs) - 1 and k < 60 and end - start < 1000 and merged:
                p, n = merged[-1], runs[i + 1]
                merged[-1] = (p[0], p[1], n[2], p[3] + n[3], p[4] + n[4])
                i, changed = i + 2, True
            else:
                merged.append(runs[i])
                i += 1
        runs = merged
    return runs


def test_absorption_is_the_fixed_point(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(150):
        at, side, runs = 0, rng.choice([0, 1]), []
        for _ in range(rng.randint(1, 14)):
            small = rng.random() < 0.6
            e = at + (rng.randint(50, 900) if small else rng.randint(1000, 3000))
            k = rng.randint(0, 59) if small else rng.randint(60, 200)
            name = ("Left", "Right")[side]
            rows.append(span(f"c{c}", name, at, e, k))
            runs.append((name, at, e, k, [at]))
            at, side = e + rng.randint(10, 300), 1 - side
        want[f"c{c}"] = sorted(tuple(sorted(r[4])) for r in absorb(runs))
    got = tn.floor_runs(calls(spark, rows)).where("not absorbed").groupBy("base", "hold").agg(F.sort_array(F.collect_list("start_ms")).alias("m")).collect()
    found = {}
    for r in got:
        found.setdefault(r.base, []).append(tuple(r.m))
    assert {b: sorted(v) for b, v in found.items()} == want


def test_chain_keeps_every_span(spark):
    rows = [span("c", "Left", 0, 2000), span("c", "Right", 2100, 2300, 10), span("c", "Left", 2400, 2900, 10), span("c", "Right", 3000, 3200, 10), span("c", "Left", 3300, 6000)]
    t = tn.turns(calls(spark, rows)).collect()
    assert len(t) == 1 and t[0].n_spans == 3 and t[0].n_absorbed == 2 and t[0].eot_gap_ms is None


def test_edge_word_is_kept_across_a_pause(spark):
    near = [span("a", "Left", 0, 500, text="say Hello"), span("a", "Left", 530, 900, text="Hello there")]
    far = [span("b", "Left", 0, 500, text="Hello"), span("b", "Left", 1900, 2400, text="Hello")]
    t = {r.base: r.transcript for r in tn.turns(calls(spark, near + far)).collect()}
    assert t == {"a": "say Hello there", "b": "Hello Hello"}
    s = {(r.base, r.start_ms): r.back_text for r in bd.spurts(calls(spark, near + far)).collect()}
    assert s[("a", 530)] == "say Hello there"


def test_lapse_splits_and_checks_pass(spark):
    rows = [span("c", "Left", 0, 2000), span("c", "Left", 10_450, 12_000), span("c", "Right", 12_500, 14_000)]
    s = calls(spark, rows)
    t = tn.turns(s)
    assert [(r.turn_index, r.start_ms, r.eot_gap_ms) for r in t.orderBy("turn_index").collect()] == [(0, 0, 8450), (1, 10_450, 500), (2, 12_500, None)]
    report = checks.report(checks.turn_votes(t, tn.pauses(tn.held_spans(s)), s)).collect()
    assert {r.failed for r in report} == {0}


def test_checks_find_faults(spark):
    s = calls(spark, [span("c", "Left", 0, 2000), span("c", "Right", 2500, 4000)])
    bad = tn.turns(s).withColumn("eot_gap_ms", F.lit(7).cast("long"))
    failed = {r.check: r.failed for r in checks.report(checks.turn_votes(bad, tn.pauses(tn.held_spans(s)), s)).collect()}
    assert failed["gap is next start less end"] == 1 and failed["last gap is null"] == 1 and failed["id unique"] == 0


def test_turn_inside_the_others_span(spark):
    rows = [span("c", "Left", 0, 5000, segs=["x"]), span("c", "Right", 1000, 2600, 200, segs=["y"]), span("c", "Left", 5200, 7000, segs=["z"])]
    t = {(r.side, r.start_ms): r for r in tn.turns(calls(spark, rows)).collect()}
    assert t[("Right", 1000)].speech_crosstalk_ms == 1600 and not t[("Right", 1000)].clean


def test_confirmation_takes_the_best_single_overlap(spark):
    s = calls(spark, [span("c", "Left", 0, 1000)])
    seg = lambda *rows: spark.createDataFrame([("c", "Left", *r) for r in rows], "base string, side string, utt string, start_ms long, end_ms long, text string")
    halves = transcript.confirm(s, seg(("a", 0, 60, "x"), ("b", 900, 960, "y"))).first()
    assert not halves.confirmed and halves.best_ms == 60 and halves.n_segs == 2
    whole = transcript.confirm(s, seg(("a", -5, 1000, "x"))).first()
    assert whole.confirmed and whole.inside_one
    none = transcript.confirm(s, seg(("a", 1000, 2000, "x"))).first()
    assert not none.confirmed and none.n_segs == 0


def test_empty_calls(spark):
    none = spark.createDataFrame([], SPANS)
    assert tn.turns(none).collect() == [] and bd.boundaries(none).collect() == []
