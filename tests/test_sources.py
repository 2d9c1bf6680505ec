"""Readers, writers, sound and vector caches on small files made here."""

import gzip
import hashlib
import io
import json
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from floorline.functions import exprs
from floorline.operators import calllog, checks, gates, labels, sampling
from floorline.sources import audio, files, sinks, vectors


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def pcm(samples, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_transcripts(spark, tmp_path):
    a = put(tmp_path, "a", "u1\tone two\nu2\nu3\tx\ty\n\n")
    b = put(tmp_path, "b", "u1\tthree\r\nu4\t\n")
    texts = files.read_text(spark, [a, b])
    assert {r.utt: r.text for r in texts.collect()} == {"u1": "three", "u2": "", "u3": "x\ty", "u4": ""}
    s = put(tmp_path, "s", "u1 r_L 0.5 1.5\nu1 r_L 9 9\nbad line\nu9 r_R 2 3\n")
    rows = files.read_segments(spark, [s], texts).orderBy("utt").collect()
    assert [(r.utt, r.reco, r.start, r.end, r.text) for r in rows] == [("u1", "r_L", 0.5, 1.5, "three"), ("u9", "r_R", 2.0, 3.0, "")]


def test_rows_from_the_first_file_there_is(spark, tmp_path):
    live, copy = str(tmp_path / "live.jsonl"), str(tmp_path / "copy.jsonl")
    with pytest.raises(FileNotFoundError, match="copy.jsonl.gz"):
        files.read_rows(spark, live, copy, "sid string, gone int")
    put(tmp_path, "copy.jsonl", '{"sid": "plain"}\n')
    assert files.read_rows(spark, live, copy, "sid string, gone int").collect() == [("plain", None)]
    put(tmp_path, "copy.jsonl.gz", gzip.compress(b'{"sid": "zipped", "gone": 3}\n'))
    assert files.read_rows(spark, live, copy, "sid string, gone int").collect() == [("zipped", 3)]
    put(tmp_path, "live.jsonl", '{"sid": "க"}\n')
    assert files.read_rows(spark, live, copy, "sid string, gone int").collect() == [("க", None)]


def test_tables_of_text(spark, tmp_path):
    tsv = put(tmp_path, "t.tsv", "idx\tverdict\n1\tComplete \n2\t\n")
    assert files.read_tsv(spark, tsv, "idx int, verdict string").collect() == [(1, "Complete "), (2, None)]
    csv = put(tmp_path, "c.csv", '﻿"idx","text"\n"1","a ""b"", c"\n')
    got = files.read_csv(spark, csv)
    assert got.columns == ["idx", "text"] and got.first().idx == "1"
    js = put(tmp_path, "m.json", json.dumps({"c1": "train", "c2": "test"}, indent=1))
    assert {r.key: r.value for r in files.read_map(spark, js).collect()} == {"c1": "train", "c2": "test"}
    index = put(tmp_path, "index.jsonl", '{"split": "dev", "sid": "s", "ordinal": 2, "offset": 512000}\n')
    assert files.read_index(spark, index).collect() == [("dev", "s", 2, 512000)]


def test_log_files_and_listings(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    put(folder, "call7.jsonl", '{"kind": "meta", "t_ms": 0}\n{"kind": "transcript", "t_ms": 5, "role": "user", "text": "hi"}\n')
    put(folder, "selftest.jsonl", '{"kind": "meta"}\n')
    log = files.read_log(spark, f"{folder}/call7.jsonl")
    assert [(r.call, r.kind, r.text) for r in log.orderBy("t_ms").collect()] == [("call7", "meta", None), ("call7", "transcript", "hi")]
    listed = files.listing(spark, str(folder), "*.jsonl")
    assert listed.count() == 2 and files.newest(listed).first().path.endswith("call7.jsonl")
    clips = spark.createDataFrame([("call7",), ("none",)], "sid string")
    assert [r.sid for r in files.only_existing(clips, "sid", listed).collect()] == ["call7"]
    content = (folder / "call7.jsonl").read_bytes()
    read = spark.read.format("binaryFile").load(f"{folder}/call7.jsonl")
    assert files.checked_digest(read, hashlib.sha256(content).hexdigest()).first().ok
    assert not files.checked_digest(read, "00").first().ok
    legs = spark.createDataFrame([("a", "Left"), ("a", "Right"), ("b", "Left"), ("c", None)], "base string, side string")
    assert {r.base for r in files.complete_calls(legs).collect()} == {"a"}


def test_sound(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(-3000, 3000, 16_000)
    put(tmp_path, "mono.wav", pcm(x))
    put(tmp_path, "stereo.wav", pcm(np.repeat(x, 2), channels=2))
    put(tmp_path, "slow.wav", pcm(x, rate=8_000))
    rows = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav").select(F.regexp_extract("path", r"(\w+)\.wav", 1).alias("name"), "content")
    head = {r.name: r.h for r in rows.select("name", audio.wav_header("content").alias("h")).collect()}
    assert head["mono"] == (1.0, 16_000, 1) and head["stereo"].channels == 2 and head["slow"].seconds == 2.0
    checked = rows.withColumn("h", audio.wav_header("content"))
    assert checked.where("name = 'mono'").select(audio.require_format(F.col("h")).alias("h")).first().h.rate == 16_000
    with pytest.raises(PySparkException, match="16 kHz mono"):
        checked.where("name <> 'mono'").select(audio.require_format(F.col("h")).alias("h")).collect()
    heard = rows.select("name", audio.wav_samples("content").alias("x"))
    for r in heard.collect():
        assert np.allclose(r.x, x / 32768)
    mono = heard.where("name = 'mono'")
    cut = lambda a, b: mono.select(audio.window(F.col("x"), F.lit(a), F.lit(b)).alias("w")).first().w
    full = np.concatenate([np.zeros(50), x / 32768, np.zeros(50)])
    for a, b in ((-50, 20), (0, 16_000), (15_990, 16_050), (-10, 16_010), (16_010, 16_020), (-30, -10)):
        assert np.allclose(cut(a, b), full[a + 50 : b + 50]), (a, b)
    back = mono.select(audio.wav_samples(audio.wav_bytes("x")).alias("y")).first().y
    assert np.abs(np.array(back) - x / 32768).max() <= 1 / 32767
    loud = spark.createDataFrame([([2.0, -2.0, 0.5 / 32767 + 1e-9, 0.49 / 32767],)], "x array<float>")
    steps = np.array(loud.select(audio.wav_samples(audio.wav_bytes("x")).alias("y")).first().y) * 32768
    assert steps.tolist() == [32767, -32767, 1, 0]
    clip = mono.select(audio.cut(F.col("x"), F.lit(900), F.lit(1100)).alias("c")).first().c
    assert clip.seconds == 0.2 and len(clip.clip) == 3200 and clip.tail_peak == pytest.approx(np.abs(x[14_400:]).max() / 32768)
    frames = mono.select(audio.frames(F.col("x")).alias("f")).first().f
    assert len(frames) == 50 and np.allclose(np.concatenate(frames), x / 32768)


def crude(x):
    """The ten features restated in NumPy."""
    rms = lambda a: float(np.sqrt(np.mean(np.square(a)))) if len(a) else 0.0
    e = [rms(x[i : i + 512]) for i in range(0, len(x) - 511, 512)] or [0.0]
    p50, p90 = np.percentile(e, 50), np.percentile(e, 90)
    end = x[-16_000:]
    sp = np.abs(np.fft.rfft(end * np.hanning(len(end))))
    half = len(sp) // 2
    return [
        len(x) / 16_000, rms(x), rms(x[-3200:]), rms(x[-8000:]), rms(x[-11_200:-3200]), np.abs(x).max(), np.mean(np.sign(x[1:]) != np.sign(x[:-1])),
        np.log1p(sp[half:].sum()) - np.log1p(sp[:half].sum()), p90 / (p50 + 1e-9), np.mean(np.array(e) > max(0.1 * p90, 1e-4)),
    ]


@pytest.mark.parametrize("n", [300, 4000, 9000, 40_000])
def test_ten_features(spark, n):
    rng = np.random.default_rng(n)
    x = (rng.normal(0, 0.1, n) * np.linspace(0, 1, n) ** 2).astype(np.float32)
    x[::7] = 0
    row = spark.createDataFrame([(x.tolist(),)], "x array<float>")
    timed = audio.time_features(F.col("x"))
    got = row.select(*[c.alias(k) for k, c in timed.items()], audio.spectral("x").alias("s")).first()
    assert np.allclose([got[k] for k in timed] + list(got.s), crude(x.astype(np.float64)), rtol=1e-6, atol=1e-9)


def test_log_mel_of_a_short_clip():
    """Padding is silence, and does not enter mean and variance."""
    rng = np.random.default_rng(2)
    x = rng.normal(0.3, 0.1, 20_000)
    got = audio.log_mel(x)
    assert got.shape == (80, 800) and got.dtype == np.float32
    assert np.allclose(got, audio.log_mel(x * 5 + 2), atol=1e-4)  # scale and offset do not matter, padding or not
    floor = got.min()
    assert np.allclose(got[:, 140:], floor) and got[:, 10:100].mean() > floor + 0.5
    long = rng.normal(0, 1, 200_000)
    assert np.allclose(audio.log_mel(long), audio.log_mel(long[-128_000:]))
    assert np.isfinite(audio.log_mel(np.empty(0))).all()
    assert audio.log_mel(x, np.eye(80, 201)).shape == (80, 800)


def test_models(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "k long, x array<double>")
    got = {r.k: r.probability for r in audio.score(rows, lambda: lambda m: m[:, 0] / 10, "x", "k", batch=3).collect()}
    assert got == {i: i / 10 for i in range(10)}
    with pytest.raises(PySparkException, match="outside"):
        audio.score(rows, lambda: lambda m: m[:, 0], "x", "k").collect()
    legs = spark.createDataFrame([("a", [1.0] * 1100), ("b", [0.0] * 512)], "leg string, samples array<float>")
    model = lambda: lambda frame, state: (float(frame.mean()) / 3 + (state or 0) * 0.1, (state or 0) + 1)
    got = [(r.leg, r.i, r.p) for r in audio.frame_probabilities(legs, model).orderBy("leg", "i").collect()]
    assert got == [("a", 0, float(np.float16(1 / 3))), ("a", 1, float(np.float16(1 / 3 + 0.1))), ("b", 0, 0.0)]


def test_vector_caches(spark, tmp_path):
    np.save(tmp_path / "plain.npy", np.array([[0.1, 0.2], [0.3, 0.4]], np.float16))
    np.savez(tmp_path / "named.npz", sid=np.array(["s1", "s2"]), X=np.array([[1.0, 2.0], [3.0, 4.0]]))
    rows = {(r.file, r.i): (r.key, r.vector) for r in vectors.read_vectors(spark, str(tmp_path)).collect()}
    assert rows["named", 1] == ("s2", [3.0, 4.0]) and rows["plain", 0] == (None, [float(np.float16(0.1)), float(np.float16(0.2))])
    half = spark.createDataFrame([([0.1],)], "x array<float>").select(vectors.half("x").alias("h")).first().h
    assert half == [float(np.float16(0.1))]
    cache = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3)], "sid string, v int")
    keys = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "sid string")
    assert vectors.joined_by_key(keys.where("sid = 's1'"), cache, "sid").collect() == [("s1", 1)]
    for sid in ("s2", "s9"):
        with pytest.raises(PySparkException, match=sid):
            vectors.joined_by_key(keys.where(F.col("sid") == sid), cache, "sid").collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "dev", "ஆ", "n", 1), ("s2", "dev", 'a "b"', None, 0), ("s3", "test", None, "m", 2)], "sid string, split string, text string, next_text string, n_wrong int")
    sinks.write_jsonl(rows, f"{tmp_path}/rows")
    assert "ஆ" in "".join(p.read_text() for p in (tmp_path / "rows").glob("*.json"))
    assert sinks.without_text(rows).columns == ["sid", "split", "n_wrong"]
    sinks.write_split_parquet(rows, f"{tmp_path}/split", most_rows=1)
    assert len(list((tmp_path / "split" / "split=dev").glob("*.parquet"))) == 2
    sinks.review_sheet(rows.select("sid", "text", "n_wrong"), f"{tmp_path}/sheet", [-F.col("n_wrong"), F.col("sid")])
    (sheet,) = (tmp_path / "sheet").glob("part-*")
    assert sheet.read_bytes().decode("utf-8-sig").split("\r\n") == ['"sid","text","n_wrong"', '"s3","","2"', '"s1","ஆ","1"', '"s2","a ""b""","0"', ""]
    assert sheet.read_bytes().startswith(b"\xef\xbb\xbf")
    old = rows.where("sid = 's1'")
    assert sinks.refuse_collisions(rows.where("sid <> 's1'"), old, "sid").count() == 2
    with pytest.raises(ValueError, match="s1"):
        sinks.refuse_collisions(rows, old, "sid")
    assert [r.value for r in sinks.summary_lines(rows.groupBy("split").agg(F.count("*").alias("n")), "split", ["n"]).orderBy("line").collect()] == ["| dev | 2 |", "| test | 1 |"]


def test_shards_without_a_task_per_split(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 3 == 0}", i, int(n)) for i, n in enumerate(rng.integers(1, 400, 900))]
    df = spark.createDataFrame(rows, "split string, key long, size long")
    got = sinks.shards_by_sum(df, "split", "key", F.col("size"), 5000).collect()
    size = {k: n for _, k, n in rows}
    for split in {r.split for r in got}:
        mine = sorted((r.key, r.shard, r.n_shards) for r in got if r.split == split)
        assert [s for _, s, _ in mine] == sorted(s for _, s, _ in mine)
        held = {}
        for k, s, n in mine:
            held[s] = held.get(s, 0) + size[k]
        assert set(held) == set(range(mine[0][2])) and max(held.values()) < 5000 + 400
    assert sorted(r.key for r in got) == list(range(900))
    ordered = sampling.pack_ordinals(df, "split", "key", 10).collect()
    for split in {r.split for r in ordered}:
        mine = sorted((r.key, r.ordinal, r.offset) for r in ordered if r.split == split)
        assert [(o, f) for _, o, f in mine] == [(i, 10 * i) for i in range(len(mine))]


def test_predicates_and_rules(spark):
    rows = spark.createDataFrame([("change", "c1", "Left"), ("hold_inter", "c1", "Right"), ("other", "c2", "Left")], "source string, base string, side string")
    got = rows.select("source", gates.is_core(F.col("source")).alias("core"), gates.is_held_back(F.col("source")).alias("held"), exprs.leg_id(F.col("base"), F.col("side")).alias("leg")).collect()
    assert [(r.core, r.held) for r in got] == [(True, False), (False, True), (False, False)] and got[0].leg == "c1_Left"
    said = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "text string, final boolean")
    assert [r.text for r in calllog.final_only(said, F.col("final")).collect()] == ["a"]
    p = spark.createDataFrame([(0.9,), (0.5,), (None,)], "p double")
    assert [r[0] for r in p.select(calllog.endpointing_delay(F.col("p"), F.lit(0.5), F.lit(1), F.lit(2))).collect()] == [1, 2, 2]
    assert checks.require(p.where("p is not null"), F.col("p") <= 1, "too much").count() == 2
    with pytest.raises(PySparkException, match="too much"):
        checks.require(p, F.col("p") < 0.9, "too much").collect()
    tags = spark.createDataFrame([("m", "qa", ""), ("m", "all", "dev")], "m string, s string, x string")
    assert [r[0] for r in tags.select(labels.job_tag(F.col("m"), F.col("s"), F.col("x"), "+new")).collect()] == ["m", "m@all-dev+new"]


def test_order_of_lines_in_blocks(spark, tmp_path):
    """The last line of an id wins though its file is read in many blocks."""
    put(tmp_path, "big", "".join(f"u{i % 500}\tt{i}\n" for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = files.read_text(spark, [f"{tmp_path}/big"])
        assert spark.read.text(f"{tmp_path}/big").rdd.getNumPartitions() > 5
        assert {r.utt: r.text for r in rows.collect()} == {f"u{i}": f"t{39_500 + i}" for i in range(500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
