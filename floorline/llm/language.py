"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence meet in log odds over the languages of the training texts:
- the page's text, under character-trigram models (hashed, smoothed) fitted on documents of known language, its
  length tempered since trigrams overlap;
- what the page declares: the `lang` of its markup, and a language code in its address (a path part, a host
  label or a country suffix), each under a confusion model whose reliability is counted from the corpus;
- where it stands: a prior per host, shrunk towards its site (the last two labels), that towards its
  address suffix, and that towards the corpus, from sums of text posteriors by grouped aggregation. A page's
  own share is taken off its host's sum, so it does not vote for itself.

Hosts that hold more than one in HOT_SHARE pages are at most HOT_SHARE, so their priors are broadcast; the
others' priors are joined by host. The models read about EXAMPLES documents of the LANGUAGES most frequent languages (documented bounds); counts and
priors cover every page.

Defined results: a null or empty page has no text evidence; a null or unreadable address belongs to the host
'' ; declarations that name no known language are no evidence; repeated rows count each; without training texts
there are no languages and every result is null; equal posteriors prefer the alphabetically first.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

EXAMPLES, BUCKETS = 6000, 1 << 15
#: Languages that are told apart: the most frequent ones (a bound of the fit).
LANGUAGES = 64
#: Trigrams after which text evidence grows only with the logarithm of their number.
TEMPER = 60.0
#: Weights, in pages, of a parent's prior against its child's counts.
SITE_WEIGHT, SUFFIX_WEIGHT, CORPUS_WEIGHT = 5.0, 20.0, 50.0
HOT_SHARE = 1000
#: Country suffixes that speak for a language (fixed values).
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt"}

_HIDDEN = re.compile(r"<(script|style|noscript|template)\b|<!--", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_MULT = np.array([2654435761, 40503, 2246822519], np.uint64)


def visible_text(html: str | None) -> str:
    """Text outside tags, comments and elements that are not shown; an element without an end hides nothing.

    Every end is searched once from where it can stand, and tags only where a bracket closes them, so the time grows
    with the length whatever the markup.
    """
    html = html or ""
    shown, at, found, open_ended = [], 0, _HIDDEN.search(html), set()
    while found:
        kind = (found[1] or "").lower()
        end = None if kind in open_ended else _CLOSING[kind].search(html, found.end())
        if end is None:
            open_ended.add(kind)
            found = _HIDDEN.search(html, found.end())
            continue
        shown.append(html[at : found.start()])
        at = end.end()
        found = _HIDDEN.search(html, at)
    text = " ".join([*shown, html[at:]])
    closed = text.rfind(">") + 1
    return entities.unescape(_TAG.sub(" ", text[:closed]) + text[closed:])


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-case text, runs of other characters as one space."""
    text = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = points[:-2] * _MULT[0] + points[1:-1] * _MULT[1] * np.uint64(31) + points[2:] * _MULT[2] * np.uint64(977)
    h ^= h >> np.uint64(17)
    return np.bincount(((h * _MULT[0]) >> np.uint64(13)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)


def fit(documents: DataFrame, examples: int = EXAMPLES) -> tuple[list[str], np.ndarray]:
    """(languages, log probability per language and trigram) from about `examples` documents of known language."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    known, n = known.where(F.col("lang").isin([r["lang"] for r in top])), sum(r["n"] for r in top)
    rows = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, examples / max(1, n))))

    def work(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                total[lang] = total.get(lang, 0) + trigram_counts(text)
        langs = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([total[x].astype(np.int64).tolist() for x in langs], pa.list_(pa.int64()))], ["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    counted = common.text_map(rows.select("lang", "text"), work, "lang string, counts array<long>")
    summed = counted.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for lang, bucket, k in summed.collect():  # languages x BUCKETS rows at most
        sums.setdefault(lang, np.zeros(BUCKETS))[bucket] = k
    langs = sorted(sums)
    table = np.stack([sums[x] for x in langs]) if langs else np.zeros((0, BUCKETS))
    smooth = table + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else table


def declared_language(html: Column, langs: list[str]) -> Column:
    """Primary subtag of the markup's lang attribute, if it is a known language."""
    code = F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(code.isin(langs), code)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def address_language(url: Column, host: Column, langs: list[str]) -> Column:
    """Language that the address names: a whole path part, the host's first label, or its country suffix."""
    if not langs:
        return F.lit(None).cast("string")
    codes = "|".join(langs)
    part = F.lower(F.regexp_extract(url, rf"(?i)^[^?#]*?://[^/?#]+/(?:[^?#]*?/)??({codes})(?:[-_][A-Za-z]{{2}})?(?=[/?#]|$)", 1))
    label = F.regexp_extract(host, rf"^({codes})\.", 1)
    suffix = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])[F.substring_index(host, ".", -1)]
    return F.coalesce(F.when(part != "", part), F.when(label != "", label), F.when(suffix.isin(langs), suffix))


def _priors(pages: DataFrame, k: int) -> DataFrame:
    """host, n, sums (of text posteriors) and base: the shrunk prior of all above the host, as pseudo-counts."""
    sums = [F.sum(F.col("text_posterior")[i]).alias(f"s{i}") for i in range(k)]
    hosts = common.stored(pages.groupBy("host", "site", "suffix").agg(F.count("*").alias("n"), *sums), "host-sums")
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    sites = hosts.groupBy("site", "suffix").agg(F.sum("n").alias("n"), *again)
    suffixes = sites.groupBy("suffix").agg(F.sum("n").alias("n"), *again)
    total = suffixes.agg(F.sum("n").alias("n"), *again).first()
    n = total["n"] or 0
    corpus = [((total[f"s{i}"] or 0.0) + 1.0 / k) / (n + 1.0) for i in range(k)]

    def shrunk(parent, weight):
        return F.array(*[(F.col(f"s{i}") + weight * parent(i)) / (F.col("n") + weight) for i in range(k)])

    suffixes = suffixes.select("suffix", shrunk(lambda i: F.lit(corpus[i]), CORPUS_WEIGHT).alias("suffix_prior"))
    sites = sites.join(suffixes, "suffix").select("site", "suffix", shrunk(lambda i: F.col("suffix_prior")[i], SUFFIX_WEIGHT).alias("site_prior"))
    return hosts.join(sites, ["site", "suffix"]).select("host", "n", F.array(*[F.col(f"s{i}") for i in range(k)]).alias("sums"), "site_prior")


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, address, host of every page."""
    spark = pages.sparkSession
    common.prepare(spark)
    langs, model = fit(documents)
    k = len(langs)
    if not k:
        none = F.lit(None)
        return pages.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("posterior"), none.cast("string").alias("text_lang"), none.cast("string").alias("declared"), none.cast("string").alias("address"), host_of(F.col("url")).alias("host"))
    held = spark.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            out = []
            for text in batch["html"].to_pylist():
                counts = trigram_counts(visible_text(text))
                some = np.flatnonzero(counts)
                n = counts[some].sum()
                score = held.value[:, some] @ counts[some]
                if n > TEMPER:
                    score = score * (TEMPER * (1 + np.log(n / TEMPER)) / n)
                out.append((score - score.max()).tolist())
            names = ["page_id", "declared", "address", "host"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.list_(pa.float64()))], [*names, "text_score"])

    host = host_of(F.col("url"))
    rows = pages.select("page_id", "html", declared_language(F.col("html"), langs).alias("declared"), address_language(F.col("url"), host, langs).alias("address"), host.alias("host"))
    rows = rows.select("page_id", "declared", "address", "host", "html")
    mapped = common.text_map(rows, work, "page_id long, declared string, address string, host string, text_score array<double>")
    scored = common.stored(mapped, "page-text-scores")
    total = F.aggregate("text_score", F.lit(0.0), lambda a, x: a + F.exp(x))
    scored = scored.withColumn("text_posterior", F.transform("text_score", lambda x: F.exp(x) / total))
    scored = scored.withColumn("site", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))

    # how often each kind of declaration agrees with the text, and how often it is made at all
    best = lambda c: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(c, F.array_max(c)).cast("int"))
    scored = scored.withColumn("text_lang", best(F.col("text_posterior")))
    sure = F.array_max("text_posterior") >= 0.9
    agree = scored.where(sure).agg(*[F.count(c).alias(c + "_n") for c in ("declared", "address")], *[F.sum((F.col(c) == F.col("text_lang")).cast("long")).alias(c + "_k") for c in ("declared", "address")]).first()

    def evidence(name):
        right = min(0.99, ((agree[name + "_k"] or 0) + 1.0) / (agree[name + "_n"] + 2.0))
        wrong = (1 - right) / max(1, k - 1)
        return lambda lang: F.when(F.col(name).isNull(), 0.0).when(F.col(name) == lang, float(np.log(right))).otherwise(float(np.log(wrong)) if wrong > 0 else -20.0)

    priors = common.stored(_priors(scored, k), "host-priors")
    n = scored.count()
    is_hot = F.col("n") * HOT_SHARE > n
    hot = priors.where(is_hot)
    by_host = scored.join(F.broadcast(hot.select("host", F.lit(True).alias("hot"))), "host", "left")
    joined = by_host.where("hot").drop("hot").join(F.broadcast(hot), "host").unionByName(by_host.where("hot is null").drop("hot").join(priors.where(~is_hot), "host"))
    prior = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.get("sums", i) - F.get("text_posterior", i) + SITE_WEIGHT * F.get("site_prior", i)) / (F.col("n") - 1 + SITE_WEIGHT))
    fused = joined.withColumn("prior", prior)
    d, a = evidence("declared"), evidence("address")
    logs = F.array(*[F.col("text_score")[i] + F.log(F.greatest(F.col("prior")[i], F.lit(1e-9))) + d(lang) + a(lang) for i, lang in enumerate(langs)])
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    weight = F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return fused.select("page_id", best(F.col("logs")).alias("lang"), (1 / weight).alias("posterior"), "text_lang", "declared", "address", "host")
