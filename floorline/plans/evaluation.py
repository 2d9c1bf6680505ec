"""Queries over scores, verdicts, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floorline import fixtures as fx
from floorline.functions import exprs
from floorline.operators import labels as lb, metrics as mt, ranking, sampling as sp
from floorline.registry import register

_SCORES_SQL = "scores AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CAST(embedding[1] AS DOUBLE) * 0.5 + 0.5 AS p, label % 3 AS source, vec_id % 4 = 0 AS dispute FROM embeddings)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, p, source, dispute from the embeddings: label 5 and up is positive, the first component scores."""
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("y"), (F.col("embedding")[0].cast("double") * 0.5 + 0.5).alias("p"), (F.col("label") % 3).alias("source"), (F.col("vec_id") % 4 == 0).alias("dispute")
    )


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} <> 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


_COUNTS_SQL = """count(*) AS n, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
    count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 0 AND pred = 0) AS tn"""
_RATES_SQL = f"""{_ratio('tp + tn', 'n')} AS acc, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
    {_ratio('fp', 'n')} AS fp_per_n, {_ratio('fn', 'n')} AS fn_per_n, {_ratio('fp', 'fp + tn')} AS fpr_std, {_ratio('fn', 'fn + tp')} AS fnr_std,
    {_ratio('greatest(tp + fn, fp + tn)', 'n')} AS majority"""


@register("confusion", f"WITH {_SCORES_SQL}, c AS (SELECT source, {_COUNTS_SQL} FROM (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM scores) GROUP BY source) SELECT *, {_RATES_SQL} FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(scores(spark, sf_dir), F.col("y"), (F.col("p") > 0.5).cast("int"), "source")


@register(
    "auc",
    f"""WITH {_SCORES_SQL} SELECT (SELECT count(*) FROM scores WHERE y = 1) AS n_pos, (SELECT count(*) FROM scores WHERE y = 0) AS n_neg,
    CAST(sum(CASE WHEN a.p > b.p THEN 2 WHEN a.p = b.p THEN 1 ELSE 0 END) AS DOUBLE) / CAST(2 * count(*) AS DOUBLE) AS auc
    FROM scores a JOIN scores b ON a.y = 1 AND b.y = 0""",
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auc(scores(spark, sf_dir), "y", "p")


_WILSON_SQL = """SELECT {by} n, k, share, greatest(0.0, (share + 1.9208 / n - 1.96 * sqrt(share * (1 - share) / n + 0.9604 / (CAST(n AS DOUBLE) * n))) / (1 + 3.8416 / n)) AS low,
    least(1.0, (share + 1.9208 / n + 1.96 * sqrt(share * (1 - share) / n + 0.9604 / (CAST(n AS DOUBLE) * n))) / (1 + 3.8416 / n)) AS high FROM w"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Formulas that engines may associate differently are compared to nine digits."""
    for name in names:
        df = df.withColumn(name, F.round(name, 9))
    return df


@register(
    "wilson",
    f"""WITH {_SCORES_SQL}, w AS (SELECT source, count(*) AS n, count(*) FILTER (y = CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS k,
    CAST(count(*) FILTER (y = CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share FROM scores GROUP BY source),
    i AS ({_WILSON_SQL.format(by='source,')}) SELECT source, n, k, share, round(low, 9) AS low, round(high, 9) AS high FROM i""",
)
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return _rounded(mt.accuracy_interval(s, F.col("y") == (F.col("p") > 0.5).cast("int"), "source"), "low", "high")


_VERDICTS_SQL = """verd AS (
  SELECT doc_id, quality AS human, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS a, CASE WHEN doc_id % 2 = 0 THEN quality ELSE 1 - toxic END AS b FROM labels
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, human, and two judges a and b (a is silent on every seventh)."""
    i = F.col("doc_id")
    return fx.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("human"), F.when(i % 7 != 0, F.col("toxic")).alias("a"), F.when(i % 2 == 0, F.col("quality")).otherwise(1 - F.col("toxic")).alias("b")
    )


@register(
    "mcnemar",
    f"""WITH RECURSIVE {_VERDICTS_SQL}, m AS (SELECT count(*) AS n, count(*) FILTER (a = human AND b <> human) AS only_a, count(*) FILTER (a <> human AND b = human) AS only_b
      FROM verd WHERE a IS NOT NULL AND b IS NOT NULL),
    tail(i, term, total) AS (SELECT CAST(0 AS BIGINT), CAST(-(only_a + only_b) * ln(2.0) AS DOUBLE), CAST(exp(-(only_a + only_b) * ln(2.0)) AS DOUBLE) FROM m
      UNION ALL SELECT i + 1, term + ln((only_a + only_b - i) / (i + 1.0)), total + exp(term + ln((only_a + only_b - i) / (i + 1.0))) FROM tail, m WHERE i < least(only_a, only_b))
    SELECT n, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT max(total) FROM tail)) END, 9) AS p FROM m""",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lb.paired(verdicts(spark, sf_dir), "a", "b", "human"), "p")


def _sweep_sql(name: str, where: str, grid: str) -> str:
    return f"""{name}0 AS (SELECT t / 100.0 AS t, y, CASE WHEN p > t / 100.0 THEN 1 ELSE 0 END AS pred FROM scores, {grid} WHERE {where}),
    {name} AS (SELECT *, {_RATES_SQL} FROM (SELECT CAST(t AS DOUBLE) AS t, {_COUNTS_SQL} FROM {name}0 GROUP BY t))"""


@register("threshold_sweep", f"WITH {_SCORES_SQL}, {_sweep_sql('sw', 'true', 'range(5, 100, 5) g(t)')} SELECT * FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.sweep(scores(spark, sf_dir), "y", "p", list(range(5, 100, 5)), 100)


@register(
    "operating_point",
    f"""WITH {_SCORES_SQL}, {_sweep_sql('dev', 'vec_id % 2 = 0', 'range(5, 100) g(t)')}, {_sweep_sql('test', 'vec_id % 2 = 1', 'range(5, 100) g(t)')},
    chosen AS (SELECT 'best_accuracy' AS point, (SELECT t FROM dev ORDER BY acc DESC, t LIMIT 1) AS t
      UNION ALL SELECT 'low_fpr', coalesce((SELECT min(t) FROM dev WHERE fpr_std <= 0.1), 0.99))
    SELECT point, c.t, d.acc AS dev_acc, d.fpr_std AS dev_fpr, d.fnr_std AS dev_fnr, e.acc AS test_acc, e.fpr_std AS test_fpr, e.fnr_std AS test_fnr
    FROM chosen c JOIN dev d ON d.t = c.t JOIN test e ON e.t = c.t""",
)
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, grid = scores(spark, sf_dir), list(range(5, 100))
    half = lambda k: mt.sweep(s.where(F.col("vec_id") % 2 == k), "y", "p", grid, 100)
    return mt.operating_points(half(0), half(1)).select("point", "t", "dev_acc", "dev_fpr", "dev_fnr", "test_acc", "test_fpr", "test_fnr")


@register(
    "subset_baselines",
    f"""WITH {_SCORES_SQL}, g AS (SELECT dispute, source, count(*) AS n, count(*) FILTER (y = CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS k, sum(y) AS pos
      FROM scores GROUP BY GROUPING SETS ((source), (dispute), ()))
    SELECT dispute, source, n, {_ratio('k', 'n')} AS acc, {_ratio('greatest(pos, n - pos)', 'n')} AS majority, {_ratio('k - greatest(pos, n - pos)', 'n')} AS delta FROM g""",
)
def subset_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return mt.subset_metrics(s, "y", "pred", [["source"], ["dispute"], []])


_QUALITY_SQL = "ql AS (SELECT d.doc_id, d.n_chars, d.source, d.lang, l.quality, l.toxic, length(d.lang) + d.doc_id % 10 AS small FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return d.join(fx.table(spark, sf_dir, "labels"), "doc_id").withColumn("small", F.length("lang") + F.col("doc_id") % 10)


def _smd_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, round((avg({f}) FILTER (quality = 1) - avg({f}) FILTER (quality = 0))
    / (sqrt((var_pop({f}) FILTER (quality = 1) + var_pop({f}) FILTER (quality = 0)) / 2) + 1e-12), 6) AS smd FROM ql"""


@register("smd_confound", f"WITH {_QUALITY_SQL} {_smd_sql('n_chars')} UNION ALL {_smd_sql('small')}")
def smd_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.smd(_quality(spark, sf_dir), "quality", ["n_chars", "small"]).withColumn("smd", F.round("smd", 6))


@register(
    "leakage_check",
    """WITH s AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, n_chars FROM documents)
    SELECT (SELECT count(DISTINCT source) FROM s) AS groups, (SELECT count(*) FROM (SELECT source FROM s GROUP BY source HAVING count(DISTINCT split) > 1)) AS leaking,
    (SELECT count(*) - count(DISTINCT n_chars) FROM s) AS repeated""",
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), "n_chars")
    return mt.leakage(d, "source", "split", "n_chars")


_MODELS = ["m0", "m1", "m2", "m3", "m4"]
_VOTES_SQL = """votes AS (
  SELECT CAST(doc_id AS VARCHAR) AS sid, 'm' || m AS model, CASE WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS human,
    CASE WHEN CASE WHEN doc_id % 10 = 1 THEN quality = 0 ELSE (doc_id * 7 + m * 3) % 5 < 2 + quality END THEN 'complete' ELSE 'incomplete' END AS verdict
  FROM labels, range(5) r(m) WHERE (doc_id + m) % 9 <> 0
)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, model, human, verdict: five judges of each labelled document, some of them silent."""
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("m")).where("(doc_id + m) % 9 <> 0")
    word = lambda c: F.when(c, "complete").otherwise("incomplete")
    return rows.select(F.col("doc_id").cast("string").alias("sid"), F.concat(F.lit("m"), "m").alias("model"), word(F.col("quality") == 1).alias("human"), word(F.when(F.col("doc_id") % 10 == 1, F.col("quality") == 0).otherwise((F.col("doc_id") * 7 + F.col("m") * 3) % 5 < 2 + F.col("quality"))).alias("verdict"))


@register("pivot_verdicts", f"WITH {_VOTES_SQL} SELECT sid, human, " + ", ".join(f"min(verdict) FILTER (model = '{m}') AS {m}" for m in _MODELS) + ", CAST(count(*) FILTER (verdict <> human) AS INTEGER) AS n_wrong FROM votes GROUP BY sid, human")
def pivot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.pivot_verdicts(votes(spark, sf_dir), _MODELS)


@register("consensus", f"WITH {_VOTES_SQL} SELECT sid, count(*) AS votes, count(*) FILTER (verdict <> human) AS against FROM votes GROUP BY sid HAVING count(*) >= 5 AND count(*) FILTER (verdict <> human) >= count(*) - 1")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.consensus_against(votes(spark, sf_dir))


_RELABEL_SQL = f"""{_VOTES_SQL}, samp AS (
  SELECT CAST(doc_id AS VARCHAR) AS sid, quality AS label_rule, CASE WHEN doc_id % 3 = 0 THEN 'change' ELSE 'hold_intra' END AS source, toxic, doc_id FROM labels
), rel AS (
  SELECT s.*, v.verdict IS NOT NULL AS llm_ok, CAST(v.verdict = 'complete' AS INTEGER) AS llm_verdict,
    coalesce(CAST(v.verdict = 'complete' AS INTEGER) <> label_rule, false) AS dispute
  FROM samp s LEFT JOIN votes v ON v.sid = s.sid AND v.model = 'm1'
)"""


def _relabelled(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    i = F.col("doc_id")
    samples = fx.table(spark, sf_dir, "labels").select(i.cast("string").alias("sid"), F.col("quality").alias("label_rule"), F.when(i % 3 == 0, "change").otherwise("hold_intra").alias("source"), "toxic", "doc_id")
    v = votes(spark, sf_dir).where("model = 'm1'").select("sid", "verdict", F.lit(0.9).alias("confidence"))
    return lb.relabel(samples, v, policy)


@register(
    "relabel_flips",
    f"""WITH {_RELABEL_SQL}, f AS (SELECT *, CASE WHEN source = 'change' OR NOT llm_ok THEN label_rule ELSE llm_verdict END AS label_final FROM rel)
    SELECT source, count(*) AS n, count(*) FILTER (llm_ok) AS judged, count(*) FILTER (llm_ok AND label_rule = 1 AND label_final = 0) AS to_incomplete,
    count(*) FILTER (llm_ok AND label_rule = 0 AND label_final = 1) AS to_complete FROM f GROUP BY source""",
)
def relabel_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.flips(_relabelled(spark, sf_dir, "core-safe"), "source")


@register(
    "policy_effect",
    f"""WITH {_RELABEL_SQL}, d AS (SELECT source, count(*) AS n, count(*) FILTER (source = 'change' AND dispute) AS differ,
      count(*) FILTER (source = 'change' AND dispute AND toxic = 0) AS k FROM rel GROUP BY source)
    SELECT source, n, differ, k, round(100.0 * (2 * k - differ) / CAST(n AS DOUBLE), 9) AS effect FROM d""",
)
def policy_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _relabelled(spark, sf_dir, "llm")
    decided = rows.where("source = 'change' and dispute").groupBy("source").agg(F.count_if(F.col("toxic") == 0).alias("k"))
    out = lb.policy_difference(rows, "source").join(decided, "source", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return out.select("source", "n", "differ", "k", F.round(lb.policy_effect(F.col("k"), F.col("differ"), F.col("n")), 9).alias("effect"))


@register(
    "label_ceiling",
    f"""WITH {_RELABEL_SQL}, p AS (SELECT dispute, count(*) AS n, count(toxic) AS seen, count(*) FILTER (toxic = label_rule) AS k FROM rel GROUP BY dispute)
    SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * (CAST(k AS DOUBLE) / seen)) / sum(n), 9) AS ceiling FROM p""",
)
def label_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lb.label_ceiling(_relabelled(spark, sf_dir, "llm"), "toxic", "label_rule", "dispute"), "ceiling")


@register(
    "agreement_stats",
    f"""WITH {_VERDICTS_SQL}, w AS (SELECT doc_id % 3 AS part, count(a) AS n, count(*) FILTER (a = human) AS k, {_ratio('count(*) FILTER (a = human)', 'count(a)')} AS share,
      {_ratio('count(*) FILTER (a = 1 AND human = 1)', 'count(*) FILTER (a = 1)')} AS precision1, {_ratio('count(*) FILTER (a = 0 AND human = 0)', 'count(*) FILTER (a = 0)')} AS precision0,
      count(*) FILTER (a IS NULL) AS errors FROM verd GROUP BY 1),
    i AS ({_WILSON_SQL.format(by='part, precision1, precision0, errors,')})
    SELECT part, n, k, share AS agreement, round(low, 9) AS low, round(high, 9) AS high, precision1, precision0, errors FROM i""",
)
def agreement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(spark, sf_dir).withColumn("part", F.col("doc_id") % 3)
    return _rounded(lb.agreement(rows, "human", "a", "part"), "low", "high")


_REPLY = """CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || '{{"verdict": "Complete", "confidence": 0.75, "reason": "ends  here"}}' || chr(10) || '```'
    WHEN 1 THEN '[{{"verdict": " incomplete", "confidence": 0.5, "reason": " goes on "}}]' WHEN 2 THEN '{{"verdict": "unsure", "confidence": 0.1}}'
    WHEN 3 THEN 'not json' WHEN 4 THEN '[]' ELSE '{{"verdict": "COMPLETE"}}' END"""


@register(
    "json_verdicts",
    """SELECT doc_id, ['complete', 'incomplete', 'error', 'error', 'error', 'complete'][doc_id % 6 + 1] AS verdict,
    CAST([0.75, 0.5, 0.0, 0.0, 0.0, 0.0][doc_id % 6 + 1] + CASE WHEN doc_id % 6 = 2 THEN 0.1 ELSE 0 END AS DOUBLE) AS confidence,
    ['ends here', 'goes on', '', '', '', ''][doc_id % 6 + 1] AS reason FROM labels""",
)
def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", F.expr(_REPLY.format().replace("chr(10)", "'\\n'")).alias("reply"))
    return rows.select("doc_id", lb.parse_verdict(F.col("reply")).alias("v")).select("doc_id", "v.verdict", "v.confidence", "v.reason")


@register(
    "verdict_normalise",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'complete' WHEN 3 THEN 'incomplete' END AS verdict FROM labels""",
)
def verdict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(x) for x in ("Complete", "complete ", "Unsure", " INCOMPLETE")]), (F.col("doc_id") % 4).cast("int"))
    return fx.table(spark, sf_dir, "labels").select("doc_id", lb.verdict_text(raw).alias("verdict"))


@register(
    "token_cost",
    """WITH u AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'other' END AS model, CAST(sum(n_chars) AS BIGINT) AS audio_tokens, count(*) AS text_tokens,
      CAST(sum(doc_id % 7) AS BIGINT) AS output_tokens FROM documents GROUP BY 1)
    SELECT *, round((audio_tokens * CASE model WHEN 'src1' THEN 1.0 ELSE 0.5 END + text_tokens * CASE model WHEN 'src1' THEN 0.25 ELSE 0.125 END
      + output_tokens * CASE model WHEN 'src1' THEN 8.0 ELSE 2.0 END) / 1e6, 9) AS usd FROM u""",
)
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("source").isin("src0", "src1"), F.col("source")).otherwise("other")
    usage = fx.table(spark, sf_dir, "documents").groupBy(model.alias("model")).agg(F.sum("n_chars").alias("audio_tokens"), F.count("*").alias("text_tokens"), F.sum(F.col("doc_id") % 7).alias("output_tokens"))
    prices = spark.createDataFrame([("src0", 0.5, 0.125, 2.0), ("src1", 1.0, 0.25, 8.0)], "model string, audio double, text double, output double")
    return _rounded(lb.cost(usage, prices, "src0"), "usd")


@register(
    "last_verdict",
    """SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1""",
)
def last_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row per key under an explicit order."""
    return lb.last_wins(fx.table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["n_chars", "doc_id"]).select("source", "lang", "doc_id", "n_chars")


_SPLIT_SQL = """grp AS (SELECT source || '-' || lang AS call, count(*) AS size FROM documents GROUP BY 1
), blocked AS (SELECT *, (row_number() OVER (ORDER BY size DESC, call) - 1) // 8 AS block FROM grp
), flat AS (SELECT *, row_number() OVER (ORDER BY block, md5(call || '|20260819')) - 1 AS i FROM blocked
), dealt AS (SELECT *, CASE WHEN i % 8 < 2 THEN 'test' WHEN i % 8 = 2 THEN 'dev' ELSE 'train' END AS s FROM flat
), placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY i) AS place FROM dealt)"""


@register("group_split", f"WITH {_SPLIT_SQL} SELECT call, CASE WHEN s = 'test' AND place > 15 OR s = 'dev' AND place > 8 THEN 'train' ELSE s END AS split FROM placed")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = fx.table(spark, sf_dir, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("call")).agg(F.count("*").alias("size"))
    return sp.group_split(groups, "call", "size", 15, 8, 20260819)


@register(
    "stratified_draw",
    """WITH s AS (SELECT lang, doc_id % 3 AS part, doc_id, row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY md5(doc_id || '|5'), doc_id) AS r FROM documents)
    SELECT lang, part, doc_id FROM s WHERE r <= greatest(1, 50 // (SELECT count(DISTINCT lang || part) FROM s)) ORDER BY md5(doc_id || '|6'), doc_id LIMIT 50""",
)
def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 3).alias("part"), "doc_id")
    return sp.stratified_draw(rows, ["lang", "part"], "doc_id", 50, 5)


@register(
    "fraction_sample",
    """WITH s AS (SELECT lang, source, doc_id, count(*) OVER (PARTITION BY lang, source) AS c, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|9'), doc_id) AS r FROM documents)
    SELECT lang, source, doc_id FROM s WHERE r <= greatest(1, CAST(round_even(0.25 * c, 0) AS INTEGER))""",
)
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.fraction_sample(fx.table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 0.25, 9)


@register("stride_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS i FROM documents) WHERE i % 8 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stride_sample(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8)


@register("hash_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|3'), doc_id LIMIT 25")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.hash_sample(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, 3)


@register(
    "packed_index",
    """SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) * 256000 AS "offset" FROM documents""",
)
def packed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of fixed-stride records in one stream per split."""
    return sp.pack_ordinals(fx.table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 256_000)


@register("key_collisions", "SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.collisions(fx.table(spark, sf_dir, "documents").where("n_chars > 2000"), fx.table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@register(
    "splice_harvest",
    """WITH b AS (SELECT doc_id, source FROM documents WHERE doc_id % 4 = 0), h AS (SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0), f AS (SELECT source FROM documents WHERE doc_id % 20 = 6)
    SELECT * FROM b UNION ALL SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM b) AND source NOT IN (SELECT source FROM f)""",
)
def splice_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sp.splice(d.where("doc_id % 4 = 0"), d.where("doc_id % 2 = 0"), d.where("doc_id % 20 = 6"), "doc_id", "source")


_EDGES = [0.0, 25.0, 50.0, 100.0, 200.0, 400.0]


@register(
    "histogram",
    f"""WITH e AS (SELECT CAST(i - 1 AS INTEGER) AS bucket, CAST({_EDGES}[i] AS DOUBLE) AS low, CAST(({_EDGES} || [1e300])[i + 1] AS DOUBLE) AS high FROM range(1, 7) r(i)),
    c AS (SELECT bucket, low, count(value) AS n FROM e LEFT JOIN events ON value >= low AND value < high GROUP BY bucket, low)
    SELECT *, CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS share FROM c""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.histogram(fx.table(spark, sf_dir, "events"), "value", _EDGES)


@register(
    "quantile_conventions",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, v[least(CAST(floor(0.9 * n) AS BIGINT), n - 1) + 1] AS floor90, v[n // 10 + 1] AS nth10,
    v[least(CAST(round_even(0.95 * (n - 1), 0) AS BIGINT), n - 1) + 1] AS nearest95,
    round(v[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] + (v[CAST(ceil(0.5 * (n - 1)) AS BIGINT) + 1] - v[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1]) * (0.5 * (n - 1) - floor(0.5 * (n - 1))), 6) AS linear50 FROM s""",
)
def quantile_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_type", "value")
    ranks = {"floor90": ranking.rank_floor(0.9), "nth10": ranking.rank_nth(10), "nearest95": ranking.rank_nearest(95)}
    a = ranking.at_ranks(e, ["event_type"], "value", ranks)
    b = ranking.linear(e, ["event_type"], "value", 0.5, "linear50").drop("n")
    return a.join(b, "event_type").withColumn("linear50", F.round("linear50", 6))


@register(
    "sample_geometry",
    """SELECT doc_id, CASE WHEN n_chars % 1000 < 350 THEN 'fast' WHEN n_chars % 1000 < 800 THEN 'mid' ELSE 'slow' END AS speed,
    CASE WHEN (doc_id % 11) / 10.0 = 1.0 THEN 4 ELSE CAST(floor((doc_id % 11) / 2.0) AS INTEGER) END AS band,
    substr(sha256(source), 1, 8) AS prompt_id FROM documents""",
)
def sample_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap speed, probability band and short identity."""
    p = (F.col("doc_id") % 11) / F.lit(10.0)
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", exprs.gap_speed(F.col("n_chars") % 1000).alias("speed"), exprs.band(p, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("band"), exprs.short_hash(F.col("source")).alias("prompt_id")
    )


_RECO = "CASE doc_id % 6 WHEN 0 THEN 'ta_IN_' || doc_id || '_Left' WHEN 1 THEN 'ta_IN_' || doc_id || '_x_Right' WHEN 2 THEN 'ta_CRESC_' || doc_id WHEN 3 THEN 'a_SHA1P_C2_' || doc_id WHEN 4 THEN 'a_SHA1P_M_' || doc_id ELSE 'zz' END"


@register(
    "recording_families",
    """SELECT doc_id, ['IN_stereo', 'IN_stereo', 'CRESC', 'SHA1P_C2', 'SHA1P_M', 'other'][doc_id % 6 + 1] AS family, doc_id % 6 < 4 AS conversational,
    CASE doc_id % 6 WHEN 0 THEN 'ta_IN_' || doc_id WHEN 1 THEN 'ta_IN_' || doc_id || '_x' END AS base, CASE doc_id % 6 WHEN 0 THEN 'Left' WHEN 1 THEN 'Right' END AS side FROM documents""",
)
def recording_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(_RECO).alias("reco"))
    base, side = exprs.leg_of(F.col("reco"))
    return rows.select("doc_id", exprs.family(F.col("reco")).alias("family"), exprs.is_conversational(F.col("reco")).alias("conversational"), base.alias("base"), side.alias("side"))
