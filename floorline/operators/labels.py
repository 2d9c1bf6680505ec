"""Verdicts, label policies and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floorline.functions.exprs import mcnemar, ratio, sample_id, wilson

VERDICTS = ("complete", "incomplete")
_VERDICT = "verdict string, confidence double, reason string"


def verdict_text(x: Column) -> Column:
    """A human's verdict, trimmed and in lower case; null for anything but the two words."""
    v = F.lower(F.trim(x))
    return F.when(v.isin(*VERDICTS), v)


def parse_verdict(reply: Column) -> Column:
    """A model's reply as (verdict, confidence, reason): code fences off, a one-element list opened, else 'error'."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```[A-Za-z]*\s*|\s*```$", ""))
    one = F.when(bare.startswith("{"), F.from_json(bare, _VERDICT))
    many = F.from_json(F.when(bare.startswith("["), bare), f"array<struct<{_VERDICT.replace(' string', ':string').replace(' double', ':double')}>>")
    got = F.coalesce(one, F.when(F.size(many) == 1, F.get(many, F.lit(0))))
    verdict = F.lower(F.trim(got["verdict"]))
    return F.struct(
        F.when(verdict.isin(*VERDICTS), verdict).otherwise("error").alias("verdict"),
        F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"),
        F.trim(F.regexp_replace(F.coalesce(got["reason"], F.lit("")), r"\s+", " ")).alias("reason"),
    )


def batch_replies(lines: DataFrame) -> DataFrame:
    """Batch-output lines (one JSON text a row, column value) as sid, verdict, confidence, reason, tokens.

    The key is the name of the audio file among the request's parts; tokens are summed per modality.
    """
    schema = (
        "request struct<contents:array<struct<parts:array<struct<text:string,fileData:struct<fileUri:string>>>>>>,"
        "response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,"
        "usageMetadata:struct<promptTokensDetails:array<struct<modality:string,tokenCount:bigint>>,candidatesTokenCount:bigint,thoughtsTokenCount:bigint>>"
    )
    j = F.from_json("value", schema)
    rows = lines.select(j.alias("j"))
    first = lambda a: F.get(a, F.lit(0))
    parts = first(F.col("j.request.contents"))["parts"]
    uri = first(F.filter(parts, lambda p: p["fileData"].isNotNull()))["fileData"]["fileUri"]
    reply = first(first(F.col("j.response.candidates"))["content"]["parts"])["text"]
    usage = F.col("j.response.usageMetadata")
    tokens = lambda kind: F.aggregate(F.filter(F.coalesce(usage["promptTokensDetails"], F.array().cast("array<struct<modality:string,tokenCount:bigint>>")), lambda d: d["modality"] == kind), F.lit(0).cast("long"), lambda a, d: a + d["tokenCount"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        F.regexp_extract(uri, r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("sid"),
        parse_verdict(reply).alias("v"),
        tokens("AUDIO").alias("audio_tokens"),
        tokens("TEXT").alias("text_tokens"),
        (zero(usage["candidatesTokenCount"]) + zero(usage["thoughtsTokenCount"])).alias("output_tokens"),
    ).select("sid", "v.*", "audio_tokens", "text_tokens", "output_tokens")


def cost(usage: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """usage (model, audio_tokens, text_tokens, output_tokens) with `usd`; unknown models cost what `default` costs.

    prices: model, audio, text, output in USD a million tokens; thinking is billed as output.
    """
    p = F.broadcast(prices)  # a price list
    other = F.broadcast(prices.where(F.col("model") == default).select(*[F.col(c).alias(f"d_{c}") for c in ("audio", "text", "output")]))
    rows = usage.join(p, "model", "left").join(other)
    rate = lambda c: F.coalesce(c, f"d_{c}")
    usd = (F.col("audio_tokens") * rate("audio") + F.col("text_tokens") * rate("text") + F.col("output_tokens") * rate("output")) / 1e6
    return rows.withColumn("usd", usd).drop("audio", "text", "output", "d_audio", "d_text", "d_output")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order per key; nothing is collected per key but the best row so far."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in others])


def relabel(samples: DataFrame, verdicts: DataFrame, policy: str = "llm") -> DataFrame:
    """samples with label_pipeline, llm_ok, llm_verdict, llm_conf, dispute and label_final under a policy.

    `llm` takes the verdict; `core-safe` keeps the rule's label on floor changes. Without a usable verdict
    llm_ok is false and the rule's label stays.
    """
    v = verdicts.where(F.col("verdict").isin(*VERDICTS)).select("sid", (F.col("verdict") == "complete").cast("int").alias("llm_verdict"), F.col("confidence").alias("llm_conf"))
    rows = samples.join(v, "sid", "left").withColumn("label_pipeline", F.col("label_rule")).withColumn("llm_ok", F.col("llm_verdict").isNotNull())
    rows = rows.withColumn("dispute", F.coalesce(F.col("llm_verdict") != F.col("label_rule"), F.lit(False)))
    safe = (F.col("source") == "change") if policy == "core-safe" else F.lit(False)
    return rows.withColumn("label_final", F.when(safe | ~F.col("llm_ok"), F.col("label_rule")).otherwise(F.col("llm_verdict")))


def agreement(rows: DataFrame, human: str, judge: str, *by: str) -> DataFrame:
    """n, k, agreement with its interval, and precision of each class, per group; null judgements are errors."""
    ok = F.col(judge).isNotNull()
    yes = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = rows.groupBy(*by).agg(
        yes(ok).alias("n"),
        yes(ok & (F.col(human) == F.col(judge))).alias("k"),
        yes(ok & (F.col(judge) == 1)).alias("said1"),
        yes((F.col(judge) == 1) & (F.col(human) == 1)).alias("true1"),
        yes(ok & (F.col(judge) == 0)).alias("said0"),
        yes((F.col(judge) == 0) & (F.col(human) == 0)).alias("true0"),
        yes(~ok).alias("errors"),
    )
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return out.select(
        *by, "n", "k", ratio(F.col("k"), F.col("n")).alias("agreement"), low.alias("low"), high.alias("high"),
        ratio(F.col("true1"), F.col("said1")).alias("precision1"), ratio(F.col("true0"), F.col("said0")).alias("precision0"), "errors",
    )


def paired(rows: DataFrame, a: str, b: str, human: str) -> DataFrame:
    """Two judges on the rows both judged: only_a, only_b right, and the exact McNemar p."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra, rb = F.col(a) == F.col(human), F.col(b) == F.col(human)
    counted = both.agg(F.count("*").alias("n"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"))
    return counted.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def pivot_verdicts(verdicts: DataFrame, models: list[str]) -> DataFrame:
    """sid and one verdict column per model, with n_wrong against `human` (carried along)."""
    wide = verdicts.groupBy("sid", "human").pivot("model", models).agg(F.min("verdict"))
    wrong = sum((F.coalesce(F.col(m) != F.col("human"), F.lit(False)).cast("int") for m in models), F.lit(0))
    return wide.withColumn("n_wrong", wrong)


def consensus_against(verdicts: DataFrame, least_votes: int = 5) -> DataFrame:
    """sid, votes, against: where all judges but at most one contradict the human, given enough votes."""
    got = verdicts.groupBy("sid").agg(F.count("verdict").alias("votes"), F.count_if(F.col("verdict") != F.col("human")).alias("against"))
    return got.where((F.col("votes") >= least_votes) & (F.col("against") >= F.col("votes") - 1))


def flips(relabelled: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, usable verdicts, and how many labels turned each way."""
    to = lambda a, b: F.count_if(F.col("llm_ok") & (F.col("label_pipeline") == a) & (F.col("label_final") == b))
    return relabelled.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("llm_ok").alias("judged"), to(1, 0).alias("to_incomplete"), to(0, 1).alias("to_complete"))


def label_ceiling(rows: DataFrame, human: str, label: str, dispute: str) -> DataFrame:
    """Accuracy of the labels weighted by the share of disputed and undisputed rows in the whole table."""
    parts = rows.groupBy(dispute).agg(F.count("*").alias("n"), F.count(human).alias("seen"), F.count_if(F.col(human) == F.col(label)).alias("k"))
    total = F.sum("n")
    return parts.agg(total.alias("n"), (F.sum(F.col("n") * ratio(F.col("k"), F.col("seen"))) / total).alias("ceiling"))


def policy_difference(relabelled: DataFrame, *by: str) -> DataFrame:
    """Rows whose label differs between the two policies: floor changes that the judge disputes."""
    return relabelled.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("source") == "change") & F.col("dispute")).alias("differ"))


def policy_effect(k: Column, n: Column, n_test: Column) -> Column:
    """Percentage points of accuracy that choosing one policy moves: k of n decided rows right, over the test set."""
    return F.when(n_test > 0, 100.0 * (2 * k - n) / n_test).otherwise(0.0)


def human_labels(sheet: DataFrame, answers: DataFrame) -> DataFrame:
    """sid, human (1 complete, 0 incomplete) of the answered clips whose sheet row has a usable verdict.

    sheet: idx, verdict; answers: idx, call, side, t in seconds.
    """
    usable = sheet.select("idx", verdict_text(F.col("verdict")).alias("verdict")).where(F.col("verdict").isin(*VERDICTS))
    return sheet_index(answers).join(usable, "idx").select("sid", (F.col("verdict") == "complete").cast("int").alias("human"))


def sheet_index(answers: DataFrame) -> DataFrame:
    """sid, idx: the number of a clip on the sheet, by its sample id."""
    t_ms = F.bround(F.col("t") * 1000).cast("long")
    return answers.select(sample_id(F.col("call"), F.col("side"), t_ms).alias("sid"), "idx")


def ready(rows: DataFrame, split: str | None = None) -> DataFrame:
    """Rows with a usable verdict, of one split or all, in the order of sid."""
    kept = rows.where("llm_ok") if split is None else rows.where("llm_ok").where(F.col("split") == split)
    return kept.orderBy("sid")


def training_rows(samples: DataFrame, language: str, dataset: str) -> DataFrame:
    """Samples in the names that training reads; a missing harvest is the core one, a missing confidence zero."""
    c = F.col
    harvest = F.coalesce(c("harvest"), F.lit("core")) if "harvest" in samples.columns else F.lit("core")
    return samples.select(
        "sid", "split", c("label").alias("endpoint_bool"), F.lit(language).alias("language"), F.lit(dataset).alias("dataset"), "label_pipeline", "llm_verdict", "dispute",
        F.coalesce(c("llm_conf"), F.lit(0.0)).alias("llm_conf"), "source", c("base").alias("call"), "gap_ms", "prev_ms", harvest.alias("harvest"),
    )


def job_tag(model: Column, source: Column, split: Column, rows_tag: str = "") -> Column:
    """Name of a batch job: the model alone for the check set, else model@source-split and the tag of its row file."""
    named = F.concat(model, F.lit("@"), source, F.when(split != "", F.concat(F.lit("-"), split)).otherwise(""), F.lit(rows_tag))
    return F.when(source == "qa", model).otherwise(named)


def owned(tag: Column, rows_tag: str = "") -> Column:
    """Whether a job belongs to a row file: by its suffix, or by having none."""
    return tag.endswith(rows_tag) if rows_tag else ~tag.contains("+")


def review_rows(verdicts: DataFrame, samples: DataFrame, numbers: DataFrame) -> DataFrame:
    """One model's verdicts (sid, verdict, confidence, reason, human) beside what a reviewer needs, in text columns.

    `agree` is yes or NO, empty where either side has no verdict; see review_order.
    """
    c = F.col
    said = F.when(c("verdict") == "complete", 1).when(c("verdict") == "incomplete", 0)
    word = lambda y: F.when(y == 1, "complete").when(y == 0, "incomplete").otherwise("")
    idx = F.coalesce("idx", F.lit(0))
    rows = verdicts.join(samples.select("sid", "label", "source", "gap_ms", "text"), "sid").join(numbers, "sid", "left")
    return rows.select(
        idx.alias("idx"), F.format_string("%03d.wav", idx).alias("clip"), c("verdict").alias("model"), F.format_string("%.2f", c("confidence")).alias("conf"), word(c("human")).alias("you"),
        F.when(said.isNull() | c("human").isNull(), "").when(said == c("human"), "yes").otherwise("NO").alias("agree"), F.lit("").alias("your_call"),
        F.when(c("label") == 1, "complete").otherwise("incomplete").alias("pipeline"), "source", F.format_string("%.3f", c("gap_ms") / 1000).alias("gap_s"), "reason",
        F.trim(F.regexp_replace(F.coalesce(c("text"), F.lit("")), r"\s+", " ")).alias("text"), "sid",
    )


def review_order() -> list[Column]:
    """Disagreements first, then by number."""
    return [F.col("agree") != "NO", F.col("idx")]


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
