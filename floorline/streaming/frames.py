"""The decoder and the call log as Structured Streaming queries; on a bounded replay they give the batch answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floorline.operators.calllog import SCHEMA
from floorline.operators.intervals import Decoder

FRAMES = "leg string, i long, p double, last boolean"


def advance(state: tuple[int, int, int, int], i: int, p: float, d: Decoder) -> tuple[tuple[int, int, int, int], tuple[int, int] | None]:
    """One frame on: state is (speaking, start, silent frames, next i); the second part is a closed span in frames."""
    speaking, start, silent, _ = state
    silent = silent + 1 if p < d.off else 0
    closed = None
    if p >= d.on:
        speaking, start = 1, start if speaking else i
    elif speaking and silent >= d.silence_frames:
        closed, speaking = (start, i - d.silence_frames + 1), 0
    return (speaking, start, silent, i + 1), closed


def decode_stream(frames: DataFrame, d: Decoder = Decoder()) -> DataFrame:
    """leg, start_ms, end_ms as spans close; a frame marked `last` ends its leg and flushes an open span.

    State per leg is four integers. Frames of a leg must not come later than a micro-batch that is past them.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("i", kind="stable")
        out, ended = [], False
        for i, p, last in zip(rows["i"], rows["p"], rows["last"]):
            now, closed = advance(now, int(i), float(p), d)
            if last and now[0]:
                closed, now = (now[1], int(i) + 1), (0, 0, 0, int(i) + 1)
            ended = ended or bool(last)
            if closed and closed[1] - closed[0] >= d.speech_frames:
                out.append((key[0], closed[0] * d.hop_ms, closed[1] * d.hop_ms))
        if ended:
            state.remove()
        else:
            state.update(now)
        yield pd.DataFrame(out, columns=["leg", "start_ms", "end_ms"])

    return frames.groupBy("leg").applyInPandasWithState(step, "leg string, start_ms long, end_ms long", "speaking int, start long, silent long, next long", "append", GroupStateTimeout.NoTimeout)


def buffer_stream(events: DataFrame, most_ms: int = 8000) -> DataFrame:
    """leg, t_ms, fill_ms: how much sound a rolling buffer holds at every `ask` of a stream of asks and clears.

    events: leg, t_ms, kind; a leg's events come in order over the batches. The state is when the buffer was cleared.
    """

    def step(key, batches, state):
        (since,) = state.get if state.exists else (0,)
        out = []
        # at one time a clear comes before an ask
        rows = pd.concat(list(batches)).assign(late=lambda x: x["kind"] == "ask").sort_values(["t_ms", "late"], kind="stable")
        for t, kind in zip(rows["t_ms"], rows["kind"]):
            if kind == "clear":
                since = int(t)
            else:
                out.append((key[0], int(t), min(most_ms, int(t) - since)))
        state.update((since,))
        yield pd.DataFrame(out, columns=["leg", "t_ms", "fill_ms"])

    return events.groupBy("leg").applyInPandasWithState(step, "leg string, t_ms long, fill_ms long", "since long", "append", GroupStateTimeout.NoTimeout)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines that others may append to at the same time.

    Appending jobs of one folder share its temporary part, which the first to end takes away; so each writes to a
    folder of its own, hidden from readers, and then moves its whole files into the log.
    """
    sc, own = rows.sparkSession.sparkContext, uuid.uuid4().hex
    part = sc._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_{own}")
    rows.write.json(part.toString())
    files = part.getFileSystem(sc._jsc.hadoopConfiguration())
    for found in files.listStatus(part):
        name = found.getPath().getName()
        if name.startswith("part-") and not files.rename(found.getPath(), sc._jvm.org.apache.hadoop.fs.Path(path, f"{own}-{name}")):
            raise OSError(f"{name} could not be moved to {path}")
    files.delete(part, True)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON logs as a stream of wide rows."""
    return spark.readStream.schema(SCHEMA).json(path)


def arrivals(log: DataFrame, window: str = "20 seconds", late: str = "30 seconds") -> DataFrame:
    """Rows per call, kind and window of event time, closed by a watermark."""
    at = log.withColumn("at", F.timestamp_millis("t_ms")).withWatermark("at", late)
    return at.groupBy("call", "kind", F.window("at", window).alias("w")).agg(F.count("*").alias("n")).select("call", "kind", F.unix_millis("w.start").alias("from_ms"), "n")


def replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what its source holds now, append its rows as Parquet under path, and return."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
