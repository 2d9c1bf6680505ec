"""Streams replayed in several micro-batches against plain Python."""

import random
import threading

from pyspark.sql import functions as F

from floorline.operators.intervals import Decoder
from floorline.streaming import frames as st


def test_decoder_over_many_batches(spark, tmp_path):
    rng = random.Random(1)
    legs = {leg: [rng.choice([0.1, 0.3, 0.4, 0.6, 0.9]) if rng.random() < 0.5 else 0.05 for _ in range(400)] for leg in "abc"}
    for part in range(4):
        rows = [(leg, i, p, i == 399) for leg, ps in legs.items() for i, p in enumerate(ps) if i // 100 == part]
        spark.createDataFrame(rows, st.FRAMES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(st.FRAMES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    st.replay(st.decode_stream(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    d, want = Decoder(), []
    for leg, ps in legs.items():
        start, low = None, 0
        for i, p in enumerate([*ps, None]):
            if p is None:
                if start is not None and i - start >= d.speech_frames:
                    want.append((leg, start * d.hop_ms, i * d.hop_ms))
                break
            low = low + 1 if p < d.off else 0
            if p >= d.on:
                start = i if start is None else start
            elif start is not None and low >= d.silence_frames:
                if i - d.silence_frames + 1 - start >= d.speech_frames:
                    want.append((leg, start * d.hop_ms, (i - d.silence_frames + 1) * d.hop_ms))
                start = None
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_buffer_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    events = sorted((rng.randrange(60_000), rng.choice(["ask", "ask", "clear"]), leg) for leg in "ab" for _ in range(200))
    for part in range(4):
        rows = [(leg, t, kind) for t, kind, leg in events if t // 15_000 == part]
        st.append_log(spark.createDataFrame(rows, "leg string, t_ms long, kind string").coalesce(1), f"{tmp_path}/in")
    stream = spark.readStream.schema("leg string, t_ms long, kind string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    st.replay(st.buffer_stream(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    want = []
    for leg in "ab":
        clears = [t for t, kind, x in events if x == leg and kind == "clear"]
        want += [(leg, t, min(8000, t - max([c for c in clears if c <= t], default=0))) for t, kind, x in events if x == leg and kind == "ask"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_writers_of_one_log_do_not_meet(spark, tmp_path):
    frames = [spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("n")) for i in range(4)]
    writers = [threading.Thread(target=st.append_log, args=(f, f"{tmp_path}/log")) for f in frames]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.n for r in spark.read.schema("n long").json(f"{tmp_path}/log").collect()) == list(range(400))


def test_arrivals_are_closed_by_the_watermark(spark, tmp_path):
    rows = [("c", "metric", t, None) for t in (0, 5_000, 25_000, 19_999, 130_000, 135_000)]
    spark.createDataFrame(rows, "call string, kind string, t_ms long, text string").write.json(f"{tmp_path}/log")
    st.replay(st.arrivals(st.read_log_stream(spark, f"{tmp_path}/log")), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("from_ms", "n").collect()) == [(0, 3), (20_000, 1)]
