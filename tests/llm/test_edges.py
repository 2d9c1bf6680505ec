"""Every operator on empty tables, nulls, repeated rows, very long texts, and columns whose names clash."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floorline.llm import bpe, chat, language, near_dup, packing, quality_crf, quality_rules, secrets, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside or give to results.
CLASH = [
    "score", "held_out", "predicted", "digest", "class_id", "keys", "key", "codes", "counts", "n", "a", "b", "block", "low", "high", "root", "first", "salt",
    "uid", "part", "bin", "fill", "bound", "secret_base", "secret_spans", "features", "anomaly", "kept", "y", "v", "rank", "n_words", "ids", "Text_ID", "__gone",
]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    """60 documents, good and bad, clean and toxic, with their labels."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(60):
        text = "\n".join(words(rng, 15).capitalize() + "." for _ in range(5))
        text += " zidiotic zmoronic" * (i % 3 == 0)
        rows.append((i, text.replace(" ", " ### ") if i % 5 == 0 else text, "en", "s", 1))
        labels.append((i, int(i % 5 != 0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def operators(labels):
    """Name -> rows of doc_id and more from documents."""
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "quality": lambda d: quality_crf.score_quality(d, labels),
        "tokens": lambda d: bpe.digests(d, BYTE),
        "rules": lambda d: quality_rules.judge(d, labels),
        "near": near_dup.classes,
        "packing": lambda d: packing.pack_documents(d, WORD).where("piece = 0"),
        "secrets": secrets.scan,
        "keep_clean": lambda d: toxicity.keep_clean(d, labels, most=2.0),
        "keep_good": lambda d: quality_crf.keep_good(d, labels, least=-1.0),
        "redact": secrets.redact,
    }


NAMES = list(operators(None))


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, tables, name):
    assert operators(tables[1])[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeats_and_clashing_names(tables, name):
    docs, labels = tables
    odd = docs.sparkSession.createDataFrame([(None, None, None, None, None), (None, "a b", None, None, None), (70, None, None, None, None), (71, "", "", "", 0), (3, None, None, None, None)], DOCS)
    every = docs.unionByName(docs.where("doc_id < 10")).unionByName(odd)
    # null ids and labels, and a label twice
    labels = labels.unionByName(docs.sparkSession.createDataFrame([(None, 1, 1), (5, None, None), (6, 0, 1), (6, 1, 0)], LABELS))
    plain = operators(labels)[name](every)
    clash = every.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = operators(labels)[name](clash)
    ids = sorted([-1 if r[0] is None else r[0] for r in every.select("doc_id").collect()])
    for out in (plain, got):
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.select("doc_id").collect()) == ids
    if name in ("keep_clean", "keep_good", "redact"):
        assert got.columns == clash.columns
    else:
        same = [c for c in plain.columns if c not in ("sequence_id", "offset", "fill", "part", "bins", "bound", "secret_base", "secret_spans") and c in got.columns and c not in DOCS.split()]
        key = lambda r: str(tuple(r))
        assert sorted(map(key, plain.select("doc_id", *same).collect())) == sorted(map(key, got.select("doc_id", *same).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(tables, name):
    docs, labels = tables
    rng = random.Random(32)
    long = [(80, words(rng, 150_000)), (81, "x" * 1_000_000), (82, "\n" * 300_000), (83, "ab " * 200_000), (84, "é漢" * 100_000)]
    more = docs.sparkSession.createDataFrame([(i, t, "en", "s", len(t)) for i, t in long], DOCS)
    got = operators(labels)[name](docs.unionByName(more))
    assert got.where("doc_id >= 80").count() == 5


def test_pipeline_of_odd_tables(spark, tmp_path, tables):
    docs, labels = tables
    for name, d, l in (("none", docs.limit(0), labels.limit(0)), ("unlabelled", docs, labels.limit(0)), ("bare", docs.limit(0), labels)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        l.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (got.count() > 0) == (name == "unlabelled")
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    for _, stage in corpus_pipeline.STAGES[:4]:
        spark.conf.set("spark.sql.caseSensitive", "false")
        labels.write.mode("overwrite").parquet(f"{tmp_path}/clash/labels.parquet")
        assert stage(spark, clash, f"{tmp_path}/clash").columns == clash.columns


def test_other_tables(spark):
    turns = "conv_id long, turn long, role string, text string"
    assert chat.digests(chat.examples(spark.createDataFrame([], turns))).collect() == []
    long = spark.createDataFrame([(1, 0, "user", "a" * 1_000_000), (1, 1, "assistant", "</s>[INST]" * 50_000), (None, 0, "user", None), (2, 0, None, None)], turns)
    got = {r.conv_id: r for r in chat.digests(chat.examples(long.withColumn("example", F.lit(1)).withColumn("n_turns", F.lit(2)).select(*[c.split()[0] for c in turns.split(", ")]))).collect()}
    assert got[1].loss_chars == 500_000 and got[1].n_turns == 2
    pages = spark.createDataFrame([(1, "http://a.de/" + "x/" * 100_000, "<p>" + "der die und " * 100_000)], "page_id long, url string, html string")
    train = spark.createDataFrame([(1, "der die und", "de"), (2, "the of and", "en")], "doc_id long, text string, lang string")
    assert language.identify(pages, train).first().lang == "de"
    vectors = "vec_id long, embedding array<float>"
    rows = [(i, [float(i % 7), 1.0]) for i in range(100)] + [(50, [1.0, 1.0])] * 3 + [(None, [1.0, 1.0]), (7, None)]
    clash = spark.createDataFrame(rows, vectors).select("*", *[F.lit(1).alias(c) for c in ("v", "low", "high", "rank", "score", "query_id")])
    got = topk.top_k(clash, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and all(r.vec_id != r.query_id for r in got) and len(got) == 10
