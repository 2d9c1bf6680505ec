"""Queries over two-leg calls, with DuckDB twins that reach the same rows by plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from floorline import fixtures as fx
from floorline.operators import boundaries as bd, checks, gates, intervals, ranking, transcript, turns as tn
from floorline.registry import register
from floorline.sources.scratch import stored

_JOIN_WORDS = """list_reduce(list_prepend('', {}), lambda a, t: CASE WHEN t = '' THEN a WHEN a = '' THEN t
  WHEN string_split(a, ' ')[-1] = string_split(t, ' ')[1] THEN a || substr(t, strlen(string_split(t, ' ')[1]) + 1) ELSE a || ' ' || t END)"""

SPURT_SQL = f"""
sp0 AS (
  SELECT *, CASE WHEN start_ms - lag(end_ms) OVER leg < 400 THEN 0 ELSE 1 END AS opens,
         lead(start_ms) OVER leg AS own_start, lead(seg) OVER leg AS own_seg
  FROM span WINDOW leg AS (PARTITION BY base, side ORDER BY start_ms)
), sp1 AS (
  SELECT *, sum(opens) OVER (PARTITION BY base, side ORDER BY start_ms) AS spurt FROM sp0
), sp AS (
  SELECT *, CAST(sum(k) OVER back AS BIGINT) AS back_k, CAST(sum(k) OVER ahead AS BIGINT) AS ahead_k,
         end_ms - min(start_ms) OVER part AS back_ms, max(end_ms) OVER part - start_ms AS ahead_ms,
         {_JOIN_WORDS.format("list(text) OVER back")} AS back_text, {_JOIN_WORDS.format("list(text) OVER ahead")} AS ahead_text
  FROM sp1 WINDOW part AS (PARTITION BY base, side, spurt),
    back AS (PARTITION BY base, side, spurt ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    ahead AS (PARTITION BY base, side, spurt ORDER BY start_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""

BOUNDARY_SQL = """
b0 AS (
  SELECT s.*, s.end_ms AS t_ms,
    (SELECT min(o.start_ms) FROM span o WHERE o.base = s.base AND o.side <> s.side AND o.start_ms > s.end_ms) AS other_start,
    (SELECT count(*) FROM span o WHERE o.base = s.base AND o.side <> s.side AND o.start_ms <= s.end_ms AND o.end_ms > s.end_ms) > 0 AS active,
    (SELECT coalesce(sum(greatest(0, least(o.end_ms, s.end_ms) - greatest(o.start_ms, s.end_ms - 1000))), 0)
     FROM span o WHERE o.base = s.base AND o.side <> s.side) AS other_before_ms
  FROM sp s WHERE s.own_start IS NOT NULL
), b1 AS (
  SELECT *, coalesce(other_start < own_start, false) AS change,
         CASE WHEN coalesce(other_start < own_start, false) THEN other_start ELSE own_start END AS next_start FROM b0
), boundary AS (
  SELECT b.base, b.side, b.t_ms, CASE WHEN b.change THEN 'change' ELSE 'hold' END AS kind, b.next_start - b.t_ms AS gap_ms,
    b.back_ms AS prev_ms, b.back_text AS prev_text, n.ahead_ms AS next_ms, n.ahead_k AS next_k, n.ahead_text AS next_text,
    CAST(b.other_before_ms AS BIGINT) AS other_before_ms,
    CAST((SELECT coalesce(sum(greatest(0, least(o.end_ms, b.next_start) - greatest(o.start_ms, b.t_ms))), 0)
     FROM span o WHERE o.base = b.base AND o.side <> b.side) AS BIGINT) AS other_gap_ms,
    b.active, b.seg <> b.own_seg AS ends_segment
  FROM b1 b JOIN sp n ON n.base = b.base AND (n.side <> b.side) = b.change AND n.start_ms = b.next_start
)"""


def _outcome_sql(g: gates.Gates) -> str:
    return f"""CASE WHEN prev_ms < {g.min_prev} THEN 'short_prev' WHEN prev_text = '' THEN 'no_text' WHEN active THEN 'straddle'
    WHEN other_before_ms > {g.max_other_before} THEN 'bargein'
    WHEN kind = 'change' THEN CASE WHEN gap_ms < {g.pos_min_gap} THEN 'pos_gap_short' WHEN gap_ms > {g.pos_max_gap} THEN 'pos_gap_long'
      WHEN next_k < {g.pos_min_next_k} OR next_ms < {g.pos_min_next} THEN 'backchannel' WHEN NOT ends_segment THEN 'change_midseg' ELSE 'change' END
    ELSE CASE WHEN gap_ms < {g.neg_min_pause} THEN 'pause_short' WHEN gap_ms > {g.neg_max_pause} THEN 'pause_long'
      WHEN other_gap_ms > {g.max_crosstalk} THEN 'other_spoke' WHEN next_ms < {g.neg_min_next} THEN 'resume_tiny'
      WHEN ends_segment THEN 'hold_inter' ELSE 'hold_intra' END END"""


_B = (fx.SPANS_SQL, SPURT_SQL, BOUNDARY_SQL)
_KEPT = "('change', 'hold_intra', 'change_midseg', 'hold_inter')"
_SID = "base || '_' || substr(side, 1, 1) || '_' || printf('%08d', t_ms)"


@register("spurts", fx.with_tables(fx.SPANS_SQL, SPURT_SQL) + " SELECT base, side, start_ms, back_ms, back_k, back_text, ahead_ms, ahead_k, ahead_text FROM sp")
def spurts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.spurts(fx.spans(spark, sf_dir)).select("base", "side", "start_ms", "back_ms", "back_k", "back_text", "ahead_ms", "ahead_k", "ahead_text")


@register("boundary_rows", fx.with_tables(*_B) + " SELECT * FROM boundary")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.boundaries(fx.spans(spark, sf_dir))


@register(
    "boundary_funnel",
    fx.with_tables(*_B, f"judged AS (SELECT *, {_outcome_sql(gates.STRICT)} AS outcome FROM boundary)")
    + """ SELECT outcome AS stage, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM judged
    UNION ALL SELECT 'cand_' || kind, count(*) FROM judged WHERE outcome NOT IN ('short_prev', 'no_text', 'straddle', 'bargein') GROUP BY 1""",
)
def boundary_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.funnel(gates.judged(bd.boundaries(fx.spans(spark, sf_dir), texts=False)))


@register(
    "samples_core",
    fx.with_tables(*_B, f"judged AS (SELECT *, {_outcome_sql(gates.STRICT)} AS outcome FROM boundary)")
    + f""" SELECT {_SID} AS sid, base, side, CAST(CASE WHEN kind = 'change' THEN 1 ELSE 0 END AS INTEGER) AS label_rule, t_ms,
    greatest(0, t_ms + 200 - 8000) AS clip_start_ms, t_ms + 200 AS clip_end_ms, gap_ms, prev_ms, prev_text AS text, outcome AS source,
    next_text, 'core' AS harvest FROM judged WHERE outcome IN {_KEPT}""",
)
def samples_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.samples(gates.judged(bd.boundaries(fx.spans(spark, sf_dir))))


@register(
    "relaxed_vs_strict",
    fx.with_tables(*_B, f"judged AS (SELECT *, {_outcome_sql(gates.STRICT)} AS strict, {_outcome_sql(gates.RELAXED)} AS relaxed FROM boundary)")
    + " SELECT strict, relaxed, count(*) AS n FROM judged GROUP BY 1, 2",
)
def relaxed_vs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of gates over the same boundaries in one projection."""
    said = F.col("prev_said")
    b = bd.boundaries(fx.spans(spark, sf_dir), texts=False).select(gates.outcome(gates.STRICT, said).alias("strict"), gates.outcome(gates.RELAXED, said).alias("relaxed"))
    return b.groupBy("strict", "relaxed").agg(F.count("*").alias("n"))


@register(
    "known_drift_new",
    fx.with_tables(*_B, f"judged AS (SELECT *, {_outcome_sql(gates.STRICT)} AS strict, {_outcome_sql(gates.RELAXED)} AS relaxed FROM boundary)")
    + f""", recorded AS (SELECT {_SID} AS sid FROM judged WHERE strict IN {_KEPT} AND t_ms % 7 <> 0),
    found AS (SELECT {_SID} AS sid, prev_ms FROM judged WHERE relaxed IN {_KEPT}),
    said AS (SELECT CASE WHEN r.sid IS NOT NULL THEN 'known' WHEN f.prev_ms >= 1000 THEN 'drift' ELSE 'new' END AS part, f.sid
             FROM found f LEFT JOIN recorded r ON r.sid = f.sid)
    SELECT part, count(*) AS n, min(sid) AS first_sid FROM said GROUP BY part
    UNION ALL SELECT 'missing', count(*), min(sid) FROM recorded WHERE sid NOT IN (SELECT sid FROM found)""",
)
def known_drift_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relaxed harvest cut into recorded, drifted and new rows, beside recorded rows that it does not reach."""
    b = bd.boundaries(fx.spans(spark, sf_dir))
    recorded = gates.samples(gates.judged(b)).where("t_ms % 7 <> 0").select("sid")
    found = gates.samples(gates.judged(b, gates.RELAXED), "relaxed").select("sid", "prev_ms")
    known = found.join(recorded, "sid", "left_semi").select("sid", F.lit("known").alias("part"))
    fresh = found.join(recorded, "sid", "left_anti").select("sid", F.when(F.col("prev_ms") >= gates.STRICT.min_prev, "drift").otherwise("new").alias("part"))
    parts = known.unionByName(fresh).groupBy("part").agg(F.count("*").alias("n"), F.min("sid").alias("first_sid"))
    missing = recorded.join(found, "sid", "left_anti").agg(F.lit("missing").alias("part"), F.count("*").alias("n"), F.min("sid").alias("first_sid"))
    return parts.unionByName(missing)


HYSTERESIS_SQL = """
h0 AS (
  SELECT *, i - coalesce(max(CASE WHEN p >= 0.35 THEN i END) OVER (PARTITION BY leg ORDER BY i), -1) AS low FROM frame
), h1 AS (
  SELECT *, CASE WHEN p >= 0.5 THEN 1 WHEN low >= 3 THEN 0 END AS ev FROM h0
), h2 AS (
  SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY leg ORDER BY i), 0) AS state FROM h1
), h3 AS (
  SELECT *, coalesce(lag(state) OVER (PARTITION BY leg ORDER BY i), 0) AS was, max(i) OVER (PARTITION BY leg) AS top FROM h2
), opened AS (SELECT leg, i AS first, top FROM h3 WHERE state = 1 AND was = 0
), closed AS (SELECT leg, i - 2 AS e FROM h3 WHERE state = 0 AND was = 1
), hyst AS (
  SELECT leg, first * 32 AS start_ms, e * 32 AS end_ms FROM (
    SELECT o.leg, o.first, coalesce((SELECT min(c.e) FROM closed c WHERE c.leg = o.leg AND c.e > o.first), o.top + 1) AS e FROM opened o)
  WHERE e - first >= 3
)"""


@register("hysteresis_spans", fx.with_tables(fx.SPANS_SQL, fx.FRAMES_SQL, HYSTERESIS_SQL) + " SELECT * FROM hyst")
def hysteresis_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.hysteresis(fx.frames(spark, sf_dir))


@register(
    "speech_seconds",
    fx.with_tables(fx.SPANS_SQL, fx.FRAMES_SQL, HYSTERESIS_SQL, "win AS (SELECT DISTINCT leg, i // 20 * 640 AS low_ms, i // 20 * 640 + 640 AS high_ms FROM frame)")
    + """ SELECT w.leg, low_ms, high_ms, CAST(coalesce(sum(greatest(0, least(h.end_ms, high_ms) - greatest(h.start_ms, low_ms))), 0) AS BIGINT) AS speech_ms
    FROM win w LEFT JOIN hyst h ON h.leg = w.leg GROUP BY 1, 2, 3""",
)
def speech_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded speech inside windows of twenty frames."""
    frames = fx.frames(spark, sf_dir)
    low = F.floor(F.col("i") / 20) * 640
    windows = frames.select("leg", low.alias("low_ms"), (low + 640).alias("high_ms")).distinct()
    return intervals.length_inside(windows, intervals.hysteresis(frames), ["leg"], "low_ms", "high_ms", "speech_ms")


@register(
    "overlap_seconds",
    fx.with_tables(fx.SPANS_SQL)
    + """ SELECT l.base, CAST(sum((SELECT coalesce(sum(greatest(0, least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms))), 0)
    FROM span r WHERE r.base = l.base AND r.side = 'Right')) AS BIGINT) AS overlap_ms FROM span l WHERE l.side = 'Left' GROUP BY l.base""",
)
def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.simultaneous(fx.spans(spark, sf_dir))


@register(
    "leg_totals",
    fx.with_tables(fx.SPANS_SQL)
    + """ SELECT base, count(*) FILTER (side = 'Left') AS left_spans, count(*) FILTER (side = 'Right') AS right_spans,
    CAST(coalesce(sum(end_ms - start_ms) FILTER (side = 'Left'), 0) AS BIGINT) AS left_ms,
    CAST(coalesce(sum(end_ms - start_ms) FILTER (side = 'Right'), 0) AS BIGINT) AS right_ms, max(end_ms) AS span_ms
    FROM span GROUP BY base HAVING count(DISTINCT side) = 2""",
)
def leg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the calls that have both legs."""
    return intervals.totals(fx.spans(spark, sf_dir)).where("left_spans > 0 and right_spans > 0")


@register(
    "clipped_spans",
    fx.with_tables(fx.SPANS_SQL)
    + """ SELECT base, side, greatest(start_ms, 100000) AS start_ms, least(end_ms, 250000) AS end_ms FROM span
    WHERE least(end_ms, 250000) > greatest(start_ms, 100000)""",
)
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip(fx.spans(spark, sf_dir), F.lit(100_000), F.lit(250_000)).select("base", "side", "start_ms", "end_ms")


@register(
    "call_timeline",
    fx.with_tables(fx.SPANS_SQL)
    + " SELECT base, side, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY base ORDER BY start_ms, end_ms, side) AS INTEGER) AS ordinal FROM span",
)
def call_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spans(spark, sf_dir).select("base", "side", "start_ms", "end_ms")
    return intervals.timeline(s.where("side = 'Left'").drop("side"), s.where("side = 'Right'").drop("side"))


CONFIRM_SQL = """
pair AS (
  SELECT s.base, s.side, s.start_ms, s.end_ms, g.utt, g.start_ms AS g0, g.end_ms AS g1,
         least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms) AS ov, g.text
  FROM span s JOIN segment g ON g.base = s.base AND g.side = s.side AND s.start_ms < g.end_ms AND g.start_ms < s.end_ms
), conf AS (
  SELECT s.base, s.side, s.start_ms, s.end_ms, coalesce(max(p.ov), 0) AS best_ms, CAST(count(p.ov) AS INTEGER) AS n_segs,
         coalesce(count(p.ov) = 1 AND min(p.g0) <= s.start_ms AND max(p.g1) >= s.end_ms, false) AS inside_one,
         coalesce(string_agg(p.utt, ',' ORDER BY p.g0, p.utt), '') AS utts
  FROM span s LEFT JOIN pair p ON p.base = s.base AND p.side = s.side AND p.start_ms = s.start_ms AND p.end_ms = s.end_ms
  GROUP BY s.base, s.side, s.start_ms, s.end_ms
)"""


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.confirm(fx.spans(spark, sf_dir), fx.segments(spark, sf_dir))


@register("confirm_spans", fx.with_tables(fx.SPANS_SQL, fx.SEGMENTS_SQL, CONFIRM_SQL) + " SELECT *, best_ms >= 100 AS confirmed FROM conf")
def confirm_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confirmed(spark, sf_dir)
    return rows.select("base", "side", "start_ms", "end_ms", "best_ms", F.col("n_segs").cast("int").alias("n_segs"), "inside_one", F.coalesce(F.array_join("utts", ","), F.lit("")).alias("utts"), "confirmed")


@register(
    "bleed_count",
    fx.with_tables(fx.SPANS_SQL, fx.SEGMENTS_SQL, CONFIRM_SQL)
    + """ SELECT count(*) AS spans, count(*) FILTER (best_ms < 100) AS dropped, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms,
    CAST(coalesce(sum(end_ms - start_ms) FILTER (best_ms < 100), 0) AS BIGINT) AS dropped_ms FROM conf""",
)
def bleed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.bleed(_confirmed(spark, sf_dir))


@register(
    "apportion_words",
    fx.with_tables(
        fx.SPANS_SQL,
        fx.SEGMENTS_SQL,
        CONFIRM_SQL,
        r"""
w AS (
  SELECT *, list_filter(regexp_split_to_array(trim(text, E' \n\t\r'), '\s+'), lambda x: x <> '') AS words FROM pair
), w1 AS (
  SELECT w.*, len(words) AS n,
    (SELECT coalesce(sum(greatest(0, least(v.end_ms, g1) - greatest(v.start_ms, g0))), 0) FROM span v WHERE v.base = w.base AND v.side = w.side) AS total,
    (SELECT coalesce(sum(greatest(0, least(v.end_ms, greatest(w.start_ms, g0)) - greatest(v.start_ms, g0))), 0) FROM span v WHERE v.base = w.base AND v.side = w.side) AS s0,
    (SELECT coalesce(sum(greatest(0, least(v.end_ms, least(w.end_ms, g1)) - greatest(v.start_ms, g0))), 0) FROM span v WHERE v.base = w.base AND v.side = w.side) AS s1
  FROM w WHERE len(words) > 0
), w2 AS (
  SELECT *, CAST(least(n, s0 * n // total) AS BIGINT) AS i0, CAST(least(n, (s1 * n * 1000 + 999 * total) // (total * 1000)) AS BIGINT) AS i1 FROM w1
)""",
    )
    + """ SELECT base, side, start_ms, end_ms, utt, i0 AS first_word, greatest(i0, i1) AS end_word,
    array_to_string(words[i0 + 1 : greatest(i0, i1)], ' ') AS text, round(CAST(n * greatest(0, s1 - s0) AS DOUBLE) / CAST(total AS DOUBLE), 6) AS n_words FROM w2""",
)
def apportion_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.apportion(fx.spans(spark, sf_dir), fx.segments(spark, sf_dir))


@register(
    "segment_edges",
    fx.with_tables(fx.SPANS_SQL)
    + """ SELECT base, side, start_ms, coalesce(seg <> lag(seg) OVER leg, true) AS starts_segment, coalesce(seg <> lead(seg) OVER leg, true) AS ends_segment
    FROM span WINDOW leg AS (PARTITION BY base, side ORDER BY start_ms)""",
)
def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    leg = Window.partitionBy("base", "side").orderBy("start_ms", "end_ms")
    apart = lambda x: ~F.coalesce(F.arrays_overlap("segs", x), F.lit(False))
    return fx.spans(spark, sf_dir).select("base", "side", "start_ms", apart(F.lag("segs").over(leg)).alias("starts_segment"), apart(F.lead("segs").over(leg)).alias("ends_segment"))


TURN_SQL = f"""
r0 AS (
  SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY base ORDER BY start_ms, end_ms, side) THEN 0 ELSE 1 END AS opens,
    coalesce(seg <> lag(seg) OVER leg, true) AS fresh, coalesce(seg <> lead(seg) OVER leg, true) AS final, lead(start_ms) OVER leg AS own_next
  FROM span WINDOW leg AS (PARTITION BY base, side ORDER BY start_ms)
), r1 AS (SELECT *, sum(opens) OVER (PARTITION BY base ORDER BY start_ms, end_ms, side) - 1 AS run FROM r0
), run0 AS (
  SELECT base, run, sum(k) < 60 AND max(end_ms) - min(start_ms) < 1000 AS bc, max(run) OVER (PARTITION BY base) AS top FROM r1 GROUP BY base, run
), run1 AS (
  SELECT *, run - max(CASE WHEN NOT bc OR run = 0 THEN run END) OVER (PARTITION BY base ORDER BY run) AS place FROM run0
), run2 AS (SELECT *, bc AND place % 2 = 1 AND run < top AS absorbed FROM run1
), run3 AS (
  SELECT *, sum(CASE WHEN absorbed OR coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY run) AS hold
  FROM (SELECT *, lag(absorbed) OVER (PARTITION BY base ORDER BY run) AS prev FROM run2)
), held0 AS (
  SELECT r1.*, hold, lag(end_ms) OVER (PARTITION BY r1.base, hold ORDER BY start_ms, end_ms) AS from_ms
  FROM r1 JOIN run3 USING (base, run) WHERE NOT absorbed
), gone AS (SELECT r1.* FROM r1 JOIN run3 USING (base, run) WHERE absorbed
), held1 AS (
  SELECT h.*, from_ms IS NULL OR start_ms - from_ms > 2000 OR
    (SELECT coalesce(sum(greatest(0, least(o.end_ms, h.start_ms) - greatest(o.start_ms, h.from_ms))), 0) FROM held0 o WHERE o.base = h.base AND o.side <> h.side) > 50 AS cut
  FROM held0 h
), held AS (
  SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY base ORDER BY hold, start_ms, end_ms) - 1 AS BIGINT) AS turn FROM held1
), pause AS (
  SELECT * FROM (SELECT base, turn, side, lag(end_ms) OVER (PARTITION BY base, turn ORDER BY start_ms, end_ms) AS start_ms, start_ms AS end_ms FROM held)
  WHERE end_ms > start_ms
), pause1 AS (
  SELECT p.*, (SELECT coalesce(sum(greatest(0, least(o.end_ms, p.end_ms) - greatest(o.start_ms, p.start_ms))), 0)
    FROM span o WHERE o.base = p.base AND o.side <> p.side) AS talk FROM pause p
), pause2 AS (
  SELECT base, turn, CAST(max(talk) AS BIGINT) AS pause_crosstalk_ms, count(*) AS n_pauses,
    string_agg(start_ms || '-' || end_ms, ',' ORDER BY start_ms) AS silence FROM pause1 GROUP BY base, turn
), t0 AS (
  SELECT base, turn, side, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(k) AS BIGINT) AS k, count(*) AS n_spans,
    CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, arg_min(fresh, start_ms) AS starts_segment, arg_max(final, start_ms) AS ends_segment,
    arg_max(own_next, start_ms) FILTER (own_next IS NOT NULL) AS some_next, max(CASE WHEN own_next IS NULL THEN 1 ELSE 0 END) AS is_last,
    list({{'t': text, 's': start_ms, 'e': end_ms}} ORDER BY start_ms, end_ms) AS parts
  FROM held GROUP BY base, turn, side
), t1 AS (
  SELECT t.*, lead(t.start_ms) OVER (PARTITION BY base ORDER BY turn) - t.end_ms AS eot_gap_ms,
    CAST((SELECT coalesce(sum(greatest(0, least(o.end_ms, t.end_ms) - greatest(o.start_ms, t.start_ms))), 0) FROM held o WHERE o.base = t.base AND o.side <> t.side) AS BIGINT) AS speech_crosstalk_ms,
    (SELECT count(*) FROM gone g WHERE g.base = t.base AND g.side <> t.side AND g.start_ms >= t.start_ms AND g.start_ms < t.end_ms) AS n_absorbed,
    CASE WHEN 2 * (k * 5000 % speech_ms) > speech_ms OR (2 * (k * 5000 % speech_ms) = speech_ms AND (k * 5000 // speech_ms) % 2 = 1)
      THEN k * 5000 // speech_ms + 1 ELSE k * 5000 // speech_ms END AS word_rate_100,
    (SELECT min(o.start_ms) FROM span o WHERE o.base = t.base AND o.side = t.side AND o.start_ms > t.end_ms) AS next_own
  FROM t0 t
), turn_row AS (
  SELECT t1.base, side, t1.turn AS turn_index, start_ms, end_ms, end_ms - start_ms AS duration_ms, k, n_spans, speech_ms, word_rate_100, eot_gap_ms,
    starts_segment, ends_segment, greatest(0, least(500, coalesce(next_own - end_ms, 500))) AS trail_ms, speech_crosstalk_ms,
    coalesce(pause_crosstalk_ms, 0) AS pause_crosstalk_ms, coalesce(n_pauses, 0) AS n_pauses, coalesce(silence, '') AS silence, n_absorbed,
    t1.base || '_' || substr(side, 1, 1) || '_' || printf('%04d', t1.turn) AS id,
    starts_segment AND ends_segment AND speech_crosstalk_ms <= 50 AND coalesce(eot_gap_ms >= 0, false) AND end_ms - start_ms >= 1000 AND word_rate_100 >= 100 AS clean,
    list_reduce(list_prepend({{'t': '', 's': 0, 'e': -1000000}}, parts), lambda a, p: {{'t': CASE WHEN p.t = '' THEN a.t WHEN a.t = '' THEN p.t
      WHEN p.s - a.e < 50 AND string_split(a.t, ' ')[-1] = string_split(p.t, ' ')[1] THEN a.t || substr(p.t, strlen(string_split(p.t, ' ')[1]) + 1)
      ELSE a.t || ' ' || p.t END, 's': p.s, 'e': p.e}}).t AS transcript
  FROM t1 LEFT JOIN pause2 ON pause2.base = t1.base AND pause2.turn = t1.turn
)"""


@register("turns", fx.with_tables(fx.SPANS_SQL, TURN_SQL) + " SELECT * FROM turn_row")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.turns(fx.spans(spark, sf_dir))


@register("turn_pauses", fx.with_tables(fx.SPANS_SQL, TURN_SQL) + " SELECT base, turn, side, start_ms, end_ms FROM pause")
def turn_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.pauses(tn.held_spans(fx.spans(spark, sf_dir)))


@register(
    "clean_funnel",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL)
    + """, g AS (SELECT [true, starts_segment, ends_segment, speech_crosstalk_ms <= 50, coalesce(eot_gap_ms >= 0, false), duration_ms >= 1000, word_rate_100 >= 100] AS ok FROM turn_row)
    SELECT CAST(s - 1 AS INTEGER) AS step, ['all', 'starts_segment', 'ends_segment', 'no_speech_crosstalk', 'gap_not_negative', 'long_enough', 'word_rate'][s] AS stage,
    count(*) FILTER (list_bool_and(ok[1:s])) AS n FROM g, range(1, 8) r(s) GROUP BY s""",
)
def clean_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.clean_funnel(tn.turns(fx.spans(spark, sf_dir)))


@register(
    "turn_report",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL)
    + """ SELECT count(*) AS n_turns, count(*) FILTER (clean) AS n_clean, CAST(sum(n_pauses) AS BIGINT) AS n_pauses, CAST(sum(n_absorbed) AS BIGINT) AS n_absorbed,
    list_sort(list(duration_ms))[least(CAST(floor(0.5 * count(*)) AS BIGINT), count(*) - 1) + 1] AS duration_p50,
    list_sort(list(duration_ms))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS duration_p90,
    max(duration_ms) AS duration_max, round(CAST(sum(duration_ms) AS DOUBLE) / count(*), 6) AS duration_mean,
    count(*) FILTER (duration_ms > 10000) AS over_10s, count(*) FILTER (eot_gap_ms < 0) AS overlapped FROM turn_row""",
)
def turn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn table in numbers."""
    rows = tn.turns(fx.spans(spark, sf_dir)).select("duration_ms", "clean", "n_pauses", "n_absorbed", "eot_gap_ms")
    rows = stored(rows, "turn-report")
    ranked = ranking.at_ranks(rows, [], "duration_ms", {"duration_p50": ranking.rank_floor(0.5), "duration_p90": ranking.rank_floor(0.9)}).drop("n")
    return F.broadcast(ranked).crossJoin(rows.agg(
        F.count("*").alias("n_turns"),
        F.count_if("clean").alias("n_clean"),
        F.sum("n_pauses").alias("n_pauses"),
        F.sum("n_absorbed").alias("n_absorbed"),
        F.max("duration_ms").alias("duration_max"),
        F.round(F.sum("duration_ms") / F.count("*"), 6).alias("duration_mean"),
        F.count_if(F.col("duration_ms") > 10_000).alias("over_10s"),
        F.count_if(F.col("eot_gap_ms") < 0).alias("overlapped"),
    ))


#: Every rule about turns, worked out again from the tables: votes and failures.
_CHECKS_SQL = """, own AS (
  SELECT s.base, s.side, s.start_ms, s.end_ms, s.k, count(t.turn_index) AS n FROM span s
  LEFT JOIN turn_row t ON t.base = s.base AND t.side = s.side AND s.start_ms >= t.start_ms AND s.end_ms <= t.end_ms GROUP BY ALL
), claimed AS (SELECT * FROM own WHERE n > 0), loose AS (SELECT * FROM own WHERE n = 0
), legs AS (
  SELECT *, lag(seg) OVER leg AS prev_seg, lead(seg) OVER leg AS next_seg, lead(start_ms) OVER leg AS own_next FROM span WINDOW leg AS (PARTITION BY base, side ORDER BY start_ms)
), again AS (
  SELECT t.*, row_number() OVER call - 1 AS place, lead(t.start_ms) OVER call AS next_start, count(*) OVER (PARTITION BY id) AS same_id,
    (SELECT count(*) FROM loose l WHERE l.base = t.base AND l.side <> t.side AND l.start_ms >= t.start_ms AND l.start_ms < t.end_ms) AS gone_n,
    (SELECT coalesce(sum(greatest(0, least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms))), 0) FROM claimed c WHERE c.base = t.base AND c.side <> t.side) AS across,
    (SELECT coalesce(sum(p.end_ms - p.start_ms), 0) FROM pause p WHERE p.base = t.base AND p.turn = t.turn_index) AS silent,
    (SELECT coalesce(max(x), 0) FROM (SELECT sum(greatest(0, least(o.end_ms, p.end_ms) - greatest(o.start_ms, p.start_ms))) AS x FROM pause p JOIN span o ON o.base = p.base AND o.side <> p.side
      WHERE p.base = t.base AND p.turn = t.turn_index GROUP BY p.start_ms)) AS inside,
    (SELECT coalesce(arg_min(l.prev_seg IS NULL OR l.prev_seg <> l.seg, l.start_ms), true) FROM legs l WHERE l.base = t.base AND l.side = t.side AND l.start_ms = t.start_ms) AS opens,
    (SELECT coalesce(arg_max(l.next_seg IS NULL OR l.next_seg <> l.seg, l.start_ms), true) FROM legs l WHERE l.base = t.base AND l.side = t.side AND l.end_ms = t.end_ms) AS closes,
    (SELECT max(l.own_next) FROM legs l WHERE l.base = t.base AND l.side = t.side AND l.end_ms = t.end_ms) AS own_next
  FROM turn_row t WINDOW call AS (PARTITION BY t.base ORDER BY t.start_ms, turn_index)
), quiet AS (
  SELECT p.*, t.start_ms AS from_ms, t.end_ms AS to_ms, lag(p.end_ms) OVER (PARTITION BY p.base, p.turn ORDER BY p.start_ms) AS was,
    (SELECT coalesce(sum(greatest(0, least(c.end_ms, p.end_ms) - greatest(c.start_ms, p.start_ms))), 0) FROM claimed c WHERE c.base = p.base AND c.side <> p.side) AS held_ms
  FROM pause p JOIN turn_row t ON t.base = p.base AND t.turn_index = p.turn
), vote AS (
"""
_RULES = {
    "own": {"no speech double-counted": "n <= 1", "no speech lost": "n >= 1 OR (k < 60 AND end_ms - start_ms < 1000)"},
    "again": {
        "id unique": "same_id = 1",
        "index contiguous": "place = turn_index",
        "duration is end less start": "duration_ms = end_ms - start_ms",
        "absorbed count": "n_absorbed = gone_n",
        "gap is next start less end": "CASE WHEN next_start IS NOT NULL THEN eot_gap_ms = next_start - end_ms END",
        "last gap is null": "CASE WHEN next_start IS NULL THEN eot_gap_ms IS NULL END",
        "no own speech in trail": "CASE WHEN own_next IS NOT NULL THEN own_next >= end_ms + trail_ms END",
        "starts segment": "starts_segment = opens",
        "ends segment": "ends_segment = closes",
        "speech is duration less pauses": "speech_ms = duration_ms - silent",
        "word rate": "CASE WHEN speech_ms > 0 THEN abs(word_rate_100 - k * 5000.0 / speech_ms) <= 1 ELSE word_rate_100 = 0 END",
        "pause crosstalk": "pause_crosstalk_ms = inside",
        "speech crosstalk": "speech_crosstalk_ms = across",
        "clean is its six gates": "clean = (starts_segment AND ends_segment AND speech_crosstalk_ms <= 50 AND coalesce(eot_gap_ms >= 0, false) AND duration_ms >= 1000 AND word_rate_100 >= 100)",
    },
    "quiet": {
        "pause inside its turn": "start_ms >= from_ms AND end_ms <= to_ms",
        "pauses ordered and disjoint": "CASE WHEN was IS NOT NULL THEN start_ms >= was END",
        "pause not empty": "end_ms > start_ms",
        "no pause hides a floor change": "held_ms <= 50",
        "no pause is a lapse": "end_ms - start_ms <= 2000",
    },
}
_VOTES_SQL = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {rule} AS ok FROM {table}" for table, rules in _RULES.items() for name, rule in rules.items())


@register(
    "turn_checks",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL) + _CHECKS_SQL + _VOTES_SQL + """) SELECT "check", count(*) AS n, count(*) FILTER (NOT ok) AS failed, '' AS sample FROM vote WHERE ok IS NOT NULL GROUP BY 1""",
)
def turn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invariant of the turn table: how often it was evaluated, and its failures, of which there are none."""
    s = stored(fx.spans(spark, sf_dir), "check-spans")
    built, silence = stored(tn.turns(s), "check-turns"), stored(tn.pauses(tn.held_spans(s)), "check-pauses")  # read by many rules
    return checks.report(checks.turn_votes(built, silence, s))


@register(
    "prev_other_message",
    """SELECT conv_id, turn, role, (SELECT arg_max(p.text, p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND trim(p.text) <> ''
      AND p.role = CASE c.role WHEN 'assistant' THEN 'user' WHEN 'user' THEN 'assistant' END) AS reply_to FROM conversations c""",
)
def prev_other_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.previous_other_message(fx.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "reply_to")


@register(
    "benchmark_turns",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL)
    + """, longest AS (SELECT base, turn, max(end_ms - start_ms) AS p FROM pause GROUP BY 1, 2)
    SELECT id, least(eot_gap_ms, 5000) AS trail_ms, n_pauses + 1 AS n_clip_spans FROM turn_row LEFT JOIN longest ON longest.base = turn_row.base AND longest.turn = turn_index
    WHERE clean AND eot_gap_ms BETWEEN 200 AND 5000 AND coalesce(p, 0) <= 5000""",
)
def benchmark_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean turns fit for a benchmark, with their pauses in clip time and the closing silence."""
    s = fx.spans(spark, sf_dir)
    quiet = tn.pauses(tn.held_spans(s)).groupBy("base", F.col("turn").alias("turn_index")).agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("spans"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest")
    )
    rows = tn.turns(s).where("clean").join(quiet, ["base", "turn_index"], "left").where(tn.eligible(F.col("eot_gap_ms"), F.col("longest")))
    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    clip = tn.clip_spans(F.coalesce("spans", none), F.col("start_ms"), F.col("duration_ms"), F.col("eot_gap_ms"))
    rows = rows.withColumn("clip", clip).withColumn("closing", F.element_at("clip", -1))
    return rows.select("id", (F.col("closing.end_ms") - F.col("closing.start_ms")).alias("trail_ms"), F.size("clip").cast("long").alias("n_clip_spans"))
