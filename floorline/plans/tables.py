"""Queries about label tables, sheets, balances, buffers and turn rows with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floorline import fixtures as fx
from floorline.operators import boundaries as bd, calllog, checks, gates, labels as lb, metrics as mt, ranking, replay as rp, sampling, turns as tn
from floorline.plans.evaluation import scores
from floorline.plans.release import _asked, _CLOSES_SQL
from floorline.plans.timeline import BOUNDARY_SQL, SPURT_SQL, TURN_SQL
from floorline.registry import register
from floorline.sources import audio, sinks, vectors
from floorline.sources.scratch import scratch
from floorline.streaming import frames as st

_SHEET_SQL = """answers AS (SELECT doc_id AS idx, 'c' || (doc_id % 7) AS call, CASE WHEN doc_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS side, doc_id * 37 AS t_ms FROM labels),
sheet AS (SELECT doc_id AS idx, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS verdict FROM labels WHERE doc_id % 5 <> 4)"""
_SID_SQL = "call || '_' || substr(side, 1, 1) || '_' || printf('%08d', t_ms)"


def _sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, i = fx.table(spark, sf_dir, "labels"), F.col("doc_id")
    answers = rows.select(
        i.alias("idx"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("call"), F.when(i % 2 == 0, "Left").otherwise("Right").alias("side"), (i * 37 / F.lit(1000.0)).alias("t")
    )
    verdict = F.when(F.col("toxic") == 1, "Unsure").when(F.col("quality") == 1, "Complete ").otherwise(" INCOMPLETE")
    return rows.where(i % 5 != 4).select(i.alias("idx"), verdict.alias("verdict")), answers


@register("human_labels", f"WITH {_SHEET_SQL} SELECT {_SID_SQL} AS sid, CAST(verdict = 'complete' AS INTEGER) AS human FROM answers JOIN sheet USING (idx) WHERE verdict <> 'unsure'")
def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewer's sheet joined with its answers by number; clips without a plain verdict drop out."""
    return lb.human_labels(*_sheet(spark, sf_dir))


@register("sheet_index", f"WITH {_SHEET_SQL} SELECT {_SID_SQL} AS sid, idx FROM answers")
def sheet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.sheet_index(_sheet(spark, sf_dir)[1])


_JOBS_SQL = """jobs AS (SELECT lang AS model, CASE WHEN doc_id % 4 = 0 THEN 'qa' ELSE 'all' END AS source, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'dev' ELSE 'test' END AS split,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE '+relaxed' END AS rows_tag FROM documents), tags AS (SELECT CASE WHEN source = 'qa' THEN model
  ELSE model || '@' || source || CASE WHEN split <> '' THEN '-' || split ELSE '' END || rows_tag END AS tag FROM jobs)"""


@register("owned_jobs", f"WITH {_JOBS_SQL} SELECT tag, contains(tag, '+') = false AS plain, suffix(tag, '+relaxed') AS relaxed, count(*) AS n FROM tags GROUP BY ALL")
def owned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of batch jobs, and which row file each belongs to."""
    i = F.col("doc_id")
    jobs = fx.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("model"), F.when(i % 4 == 0, "qa").otherwise("all").alias("source"), F.when(i % 3 == 0, "").when(i % 3 == 1, "dev").otherwise("test").alias("split"), (i % 2).alias("relaxed")
    )
    tag = lambda suffix: lb.job_tag(F.col("model"), F.col("source"), F.col("split"), suffix)
    tags = jobs.select(F.when(F.col("relaxed") == 0, tag("")).otherwise(tag("+relaxed")).alias("tag"))
    return tags.groupBy("tag", lb.owned(F.col("tag")).alias("plain"), lb.owned(F.col("tag"), "+relaxed").alias("relaxed")).agg(F.count("*").alias("n"))


_GOLD_SQL = """kept AS (SELECT *, base || '_' || substr(side, 1, 1) || '_' || printf('%08d', t_ms) AS sid FROM boundary WHERE prev_ms >= 300),
gold AS (SELECT sid, base, side, t_ms, CAST(kind = 'change' AS INTEGER) AS label, t_ms % 5 <> 0 AS llm_ok, gap_ms, prev_ms, kind FROM kept)"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at the ends of spans: the kind of boundary, disputed now and then, unusable at every fifth millisecond."""
    from floorline.functions.exprs import sample_id

    c = F.col
    b = bd.boundaries(fx.spans(spark, sf_dir)).where("prev_ms >= 300")
    return b.select(
        sample_id(c("base"), c("side"), c("t_ms")).alias("sid"), "base", "side", "t_ms", F.when(c("kind") == "change", 1).otherwise(0).alias("label"),
        F.when(c("t_ms") % 3 == 0, 1).otherwise(0).alias("label_pipeline"), (c("t_ms") % 2).cast("int").alias("llm_verdict"), F.lit(0.5).alias("llm_conf"),
        (c("t_ms") % 3 == 1).alias("dispute"), c("kind").alias("source"), F.lit("core").alias("harvest"), (c("t_ms") % 5 != 0).alias("llm_ok"), "gap_ms", "prev_ms",
    )


_SPLIT_SQL = "CASE CAST(base AS BIGINT) % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("base").cast("long") % 4
    return fx.spans(spark, sf_dir).select("base").distinct().withColumn("split", F.when(part == 0, "test").when(part == 1, "dev").otherwise("train"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg's recording ends 200 ms behind its last span."""
    return fx.spans(spark, sf_dir).groupBy("base", "side").agg((F.max("end_ms") + 200).alias("wav_ms"))


@register(
    "labelled_turns",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL, SPURT_SQL, BOUNDARY_SQL, _GOLD_SQL)
    + f""", wav AS (SELECT base, side, max(end_ms) + 200 AS wav_ms FROM span GROUP BY 1, 2)
    SELECT id, least(trail_ms, greatest(0, wav_ms - end_ms)) AS trail_ms, sid, label, CASE WHEN sid IS NOT NULL THEN CAST(t_ms % 3 = 0 AS INTEGER) END AS label_pipeline,
    CAST(t_ms % 2 AS INTEGER) AS llm_verdict, CASE WHEN sid IS NOT NULL THEN 0.5::DOUBLE END AS llm_conf, t_ms % 3 = 1 AS dispute, kind AS source,
    CASE WHEN sid IS NOT NULL THEN 'core' END AS harvest, {_SPLIT_SQL.replace('base', 'turn_row.base')} AS split
    FROM turn_row JOIN wav USING (base, side) LEFT JOIN (SELECT * FROM gold WHERE llm_ok) g ON g.base = turn_row.base AND g.side = turn_row.side AND g.t_ms = end_ms""",
)
def labelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their trail inside the recording, the label of their end and the split of their call."""
    rows = tn.labelled(tn.turns(fx.spans(spark, sf_dir), _recorded(spark, sf_dir)), _gold(spark, sf_dir), _splits(spark, sf_dir))
    return rows.select("id", "trail_ms", *tn.LABEL_FIELDS, "split")


@register(
    "table_checks",
    fx.with_tables(fx.SPANS_SQL, TURN_SQL, SPURT_SQL, BOUNDARY_SQL, _GOLD_SQL)
    + f""", n AS (SELECT count(*) AS turns, count(DISTINCT base) AS calls FROM turn_row), lab AS (SELECT count(*) AS n FROM turn_row t JOIN gold g ON g.llm_ok AND g.base = t.base AND g.side = t.side AND g.t_ms = t.end_ms),
    per AS (SELECT {_SPLIT_SQL} AS split, count(DISTINCT base) AS calls FROM turn_row GROUP BY 1)
    SELECT 'split is the call''s' AS "check", turns AS n, CAST(0 AS BIGINT) AS failed FROM n UNION ALL SELECT 'audio window inside the recording', turns, 0 FROM n
    UNION ALL SELECT 'label belongs to this end', n, 0 FROM lab UNION ALL SELECT 'call present', (SELECT count(DISTINCT base) FROM span), (SELECT count(DISTINCT base) FROM span) - calls FROM n
    UNION ALL SELECT 'calls of the split', 3, (SELECT 3 - count(*) FILTER (calls >= 1 AND calls = (SELECT count(DISTINCT base) FROM span s2 WHERE {_SPLIT_SQL.replace('base', 's2.base')} = per.split)) FROM per)""",
)
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that need splits, recordings and labels, with how often each was evaluated."""
    splits, recorded = _splits(spark, sf_dir), _recorded(spark, sf_dir)
    wanted = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three splits
    rows = tn.labelled(tn.turns(fx.spans(spark, sf_dir), recorded), _gold(spark, sf_dir), splits)
    return checks.report(checks.table_votes(rows, splits, recorded, wanted)).select("check", "n", "failed")


@register(
    "class_counts",
    fx.with_tables(fx.SPANS_SQL, SPURT_SQL, BOUNDARY_SQL)
    + f""" SELECT kind AS source, {_SPLIT_SQL} AS split, count(*) AS n, count(DISTINCT base) AS calls, count(*) FILTER (kind = 'change') AS positive, CASE WHEN kind = 'change' THEN 'core' END AS kind
    FROM boundary GROUP BY 1, 2""",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and contributing calls per class and split."""
    b = bd.boundaries(fx.spans(spark, sf_dir)).select("base", F.col("kind").alias("source"), F.when(F.col("kind") == "change", 1).otherwise(0).alias("label_rule"))
    return gates.class_counts(b.join(F.broadcast(_splits(spark, sf_dir)), "base"), "split")


@register(
    "corpus_balance",
    fx.with_tables(fx.SPANS_SQL)
    + """, leg AS (SELECT base, side, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, max(end_ms) + 200 AS wav_ms FROM span GROUP BY 1, 2),
    call AS (SELECT base, sum(n) AS n, sum(ms) AS ms, max(wav_ms) AS wav_ms, max(wav_ms) - min(wav_ms) AS mismatch_ms, CAST(min(ms) AS DOUBLE) / max(ms) AS balance FROM leg GROUP BY 1 HAVING count(*) = 2)
    SELECT count(*) AS calls, CAST(sum(wav_ms) AS BIGINT) AS wav_ms, CAST(sum(ms) AS BIGINT) AS speech_ms, CAST(sum(n) AS BIGINT) AS segments, count(*) FILTER (mismatch_ms > 50) AS mismatched,
    list_sort(list(balance))[count(*) // 10 + 1] AS balance_p10, list_sort(list(balance))[count(*) // 2 + 1] AS balance_p50 FROM call""",
)
def corpus_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over calls, and how evenly their legs speak."""
    return rp.balance(rp.manifest(fx.spans(spark, sf_dir), _recorded(spark, sf_dir)))


@register(
    "buffer_fill",
    fx.with_tables(fx.SPANS_SQL, _CLOSES_SQL)
    + """, f AS (SELECT least(8000, a.asked_ms - coalesce((SELECT max(b.t_ms) FROM bounds b WHERE b.leg = a.leg AND b.k % 2 = 0 AND b.t_ms <= a.asked_ms), 0)) AS fill_ms FROM asked a WHERE asked_ms IS NOT NULL)
    SELECT count(*) AS n, list_sort(list(fill_ms))[count(*) // 10 + 1] AS p10, list_sort(list(fill_ms))[count(*) // 2 + 1] AS p50,
    list_sort(list(fill_ms))[least(9 * count(*) // 10, count(*) - 1) + 1] AS p90, count(*) FILTER (fill_ms < 7900) AS short FROM f""",
)
def buffer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much sound a rolling buffer held when the detector was asked; some ends clear it."""
    asked = _asked(spark, sf_dir)
    filled = rp.buffered(asked, asked.where("k % 2 = 0").select("leg", "t_ms"))
    spread = rp.spread(filled, "fill_ms").select("n", "p10", "p50", "p90")
    return spread.crossJoin(F.broadcast(filled.agg(F.count_if(F.col("fill_ms") < rp.SHORT_MS).alias("short"))))  # a row each


@register(
    "stream_buffer",
    fx.with_tables(fx.SPANS_SQL, _CLOSES_SQL)
    + """ SELECT a.leg, a.asked_ms AS t_ms, least(8000, a.asked_ms - coalesce((SELECT max(b.t_ms) FROM bounds b WHERE b.leg = a.leg AND b.k % 2 = 0 AND b.t_ms <= a.asked_ms
    AND EXISTS (SELECT 1 FROM asked x WHERE x.leg = b.leg AND x.t_ms = b.t_ms)), 0)) AS fill_ms FROM asked a WHERE asked_ms IS NOT NULL""",
)
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling buffer over a replayed stream of asks and turn boundaries."""
    source, out, checkpoint = scratch(spark, "buffer"), scratch(spark, "fills"), scratch(spark, "checkpoint")
    asked = _asked(spark, sf_dir)
    asks = asked.where("asked_ms is not null").select("leg", F.col("asked_ms").alias("t_ms"), F.lit("ask").alias("kind"))
    st.append_log(asks.unionByName(asked.where("k % 2 = 0").select("leg", "t_ms", F.lit("clear").alias("kind"))), source)
    st.replay(st.buffer_stream(spark.readStream.schema("leg string, t_ms long, kind string").json(source)), out, checkpoint)
    return spark.read.schema("leg string, t_ms long, fill_ms long").parquet(out)


@register(
    "evenly_spaced",
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place, count(*) OVER () AS total FROM documents)
    SELECT doc_id FROM o WHERE place IN (SELECT CAST(floor(CAST(i * (total - 1) AS DOUBLE) / 255) AS BIGINT) FROM range(256) r(i), (SELECT max(total) AS total FROM o))""",
)
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 rows evenly spaced in the order of ids as text, first and last included: the sampling is the feature."""
    return sampling.evenly_spaced(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 256)


@register(
    "capacity_gap",
    """WITH s AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CAST(embedding[1] AS DOUBLE) * 0.5 + 0.5 AS p, CASE WHEN vec_id % 4 = 0 THEN 'dev' ELSE 'train' END AS split FROM embeddings),
    a AS (SELECT CAST(count(*) FILTER (split = 'train' AND CAST(p > 0.5 AS INTEGER) = y) AS DOUBLE) / count(*) FILTER (split = 'train') AS train_acc,
    CAST(count(*) FILTER (split = 'dev' AND CAST(p > 0.5 AS INTEGER) = y) AS DOUBLE) / count(*) FILTER (split = 'dev') AS dev_acc FROM s) SELECT *, train_acc - dev_acc AS gap FROM a""",
)
def capacity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("split", F.when(F.col("vec_id") % 4 == 0, "dev").otherwise("train"))
    return mt.capacity_gap(rows, "y", "p", "split")


@register(
    "tail_ratios",
    """WITH x AS (SELECT list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS v FROM embeddings), r AS (SELECT list_max(v[49:64]) / list_max(v[1:48]) AS r FROM x WHERE list_max(v[1:48]) > 0)
    SELECT count(*) AS n, list_sort(list(r))[least(CAST(floor(0.5 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p50, list_sort(list(r))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90,
    list_sort(list(r))[least(CAST(floor(0.99 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p99, count(*) FILTER (r > 0.05) AS over_5, count(*) FILTER (r > 0.1) AS over_10, count(*) FILTER (r > 0.2) AS over_20 FROM r""",
)
def tail_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How loud the last quarter of each vector is against the rest, taken as sound."""
    e = fx.table(spark, sf_dir, "embeddings").select(audio.tail_ratio(F.slice("embedding", 1, 48), F.slice("embedding", 49, 16)).alias("r")).where("r is not null")
    ranks = ranking.at_ranks(e, [], "r", {"p50": ranking.rank_floor(0.5), "p90": ranking.rank_floor(0.9), "p99": ranking.rank_floor(0.99)})
    over = e.agg(*[F.count_if(F.col("r") > t / 100).alias(f"over_{t}") for t in (5, 10, 20)])
    return ranks.crossJoin(F.broadcast(over))  # a row each


@register(
    "review_sheet",
    f"""WITH {_SHEET_SQL}, v AS (SELECT {_SID_SQL} AS sid, idx, CASE WHEN idx % 3 = 0 THEN 'complete' WHEN idx % 3 = 1 THEN 'incomplete' ELSE 'error' END AS verdict,
    CASE WHEN quality = 1 THEN 1 ELSE 0 END AS human, toxic FROM answers JOIN labels ON doc_id = idx),
    r AS (SELECT idx, printf('%03d.wav', idx) AS clip, verdict, CASE WHEN verdict = 'error' THEN '' WHEN (verdict = 'complete') = (human = 1) THEN 'yes' ELSE 'NO' END AS agree, human, toxic, sid FROM v),
    l AS (SELECT 1 AS head, agree <> 'NO' AS o, idx, '"' || idx || '","' || clip || '","' || verdict || '","0.50","' || CASE WHEN human = 1 THEN 'complete' ELSE 'incomplete' END || '","' || agree || '","","'
      || CASE WHEN toxic = 1 THEN 'complete' ELSE 'incomplete' END || '","s","0.250","say ""so"" now","two words","' || sid || '"' AS value FROM r
      UNION ALL SELECT 0, NULL, NULL, chr(65279) || '"idx","clip","model","conf","you","agree","your_call","pipeline","source","gap_s","reason","text","sid"')
    SELECT value FROM l""",
)
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's review sheet as its lines: quoted, behind a byte-order mark, disagreements first."""
    _, answers = _sheet(spark, sf_dir)
    numbers = lb.sheet_index(answers)
    known = numbers.join(fx.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "idx"), "idx")
    verdict = F.when(F.col("idx") % 3 == 0, "complete").when(F.col("idx") % 3 == 1, "incomplete").otherwise("error")
    v = known.select("sid", verdict.alias("verdict"), F.lit(0.5).alias("confidence"), F.lit('say "so" now').alias("reason"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("human"))
    samples = known.select("sid", F.col("toxic").alias("label"), F.lit("s").alias("source"), F.lit(250).alias("gap_ms"), F.lit(" two \n words").alias("text"))
    return sinks.sheet_lines(lb.review_rows(v, samples, numbers), lb.review_order())


@register(
    "training_rows",
    fx.with_tables(fx.SPANS_SQL, SPURT_SQL, BOUNDARY_SQL, _GOLD_SQL)
    + f""" SELECT sid, {_SPLIT_SQL} AS split, label AS endpoint_bool, 'xx' AS language, 'calls' AS dataset, CAST(t_ms % 3 = 0 AS INTEGER) AS label_pipeline, CAST(t_ms % 2 AS INTEGER) AS llm_verdict,
    t_ms % 3 = 1 AS dispute, 0.5::DOUBLE AS llm_conf, kind AS source, base AS call, gap_ms, prev_ms, 'core' AS harvest FROM gold WHERE llm_ok AND {_SPLIT_SQL} = 'dev'""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable samples of one split, in order, in the names that training reads."""
    rows = _gold(spark, sf_dir).join(F.broadcast(_splits(spark, sf_dir)), "base")
    return lb.training_rows(lb.ready(rows, "dev"), "xx", "calls")


@register(
    "verdict_subset",
    "SELECT doc_id AS sid, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
)
def verdict_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached verdicts of wanted keys."""
    cache = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid"), "quality")
    return sinks.only_keys(cache, fx.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("sid")), "sid")


@register(
    "session_rows",
    """SELECT CAST(user_id AS VARCHAR) AS call, 'session' AS kind, event_id * 10 - 5 AS t_ms, CAST(value AS VARCHAR) AS probability, NULL::VARCHAR AS unlikely_threshold, NULL::VARCHAR AS endpointing_delay,
    event_type AS language, NULL::VARCHAR AS "trigger", NULL::VARCHAR AS from_cache FROM events WHERE event_type IN ('view', 'click')""",
)
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug records that predict a turn's end, with the listed fields alone."""
    e = fx.table(spark, sf_dir, "events")
    extra = F.create_map(F.lit("probability"), F.col("value").cast("string"), F.lit("language"), F.col("event_type"), F.lit("thread"), F.lit("7"))
    message = F.when(F.col("event_type").isin("view", "click"), calllog.SESSION_MESSAGE).otherwise("other")
    records = e.select(F.col("user_id").cast("string").alias("call"), message.alias("message"), (F.col("event_id") * 10).alias("created_ms"), extra.alias("extra"))
    return calllog.session_rows(records, F.lit(5))


@register(
    "endpointing",
    "SELECT vec_id, CASE WHEN CAST(embedding[1] AS DOUBLE) > CAST(embedding[2] AS DOUBLE) THEN 300 ELSE 2500 END AS delay_ms FROM embeddings",
)
def endpointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a detector waits, by its probability and threshold."""
    part = lambda i: F.col("embedding")[i].cast("double")
    delay = calllog.endpointing_delay(part(0), part(1), F.lit(300), F.lit(2500))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", delay.alias("delay_ms"))


@register(
    "cached_vectors",
    "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings",
)
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined with their cached vectors by key, never by position."""
    e = fx.table(spark, sf_dir, "embeddings")
    found = vectors.joined_by_key(e.select("vec_id", "label"), e.select("vec_id", "embedding"), "vec_id")
    return found.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))
