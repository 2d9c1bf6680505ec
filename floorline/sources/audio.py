"""WAV bytes and signal features, in Arrow batches; models come in as callables."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Types as objects: a worker that imports this module has no session to parse their names.
HEADER = T.StructType([T.StructField("seconds", T.DoubleType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType())])
SPECTRAL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("tilt", "p90_over_p50", "voiced_frac")])

RATE = 16_000
CLIP_SAMPLES, FRAME, HOP, MELS = 8 * RATE, 400, 160, 80
#: Samples of a frame whose energy is taken, and the least energy of a voiced frame.
ENERGY_FRAME, SILENCE = 512, 1e-4


def _open(content: bytes) -> tuple[np.ndarray, int]:
    """(samples by channel as float, rate) of 16-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return x.astype(np.float32) / 32768, w.getframerate()


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    out = []
    for c in content:
        with wave.open(io.BytesIO(c)) as w:
            out.append((w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels()))
    return pd.DataFrame(out, columns=["seconds", "rate", "channels"])


def require_format(header: Column) -> Column:
    """The header, or a failed job where the sound is not 16 kHz mono."""
    return F.when((header["rate"] == RATE) & (header["channels"] == 1), header).otherwise(F.raise_error(F.lit("16 kHz mono is required")).cast("struct<seconds:double,rate:int,channels:int>"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """All samples, channels averaged."""
    return pd.Series([_open(c)[0].mean(axis=1) for c in content])


def window(samples: Column, start: Column, end: Column) -> Column:
    """Samples [start, end), padded with zeros where the window leaves the recording."""
    n = F.size(samples)
    zero = F.lit(0.0).cast("float")
    a, b = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    lead, tail = F.least(F.greatest(-start, F.lit(0)), end - start), F.greatest(end - F.greatest(start, n), F.lit(0))
    return F.concat(F.array_repeat(zero, lead.cast("int")), F.slice(samples, (a + 1).cast("int"), (b - a).cast("int")), F.array_repeat(zero, tail.cast("int")))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series) -> pd.Series:
    """16 kHz mono PCM of samples clipped to [-1, 1] and rounded to the nearest step."""

    def write(x) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
            w.writeframes(np.rint(np.clip(np.asarray(x, np.float32), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([write(x) for x in samples])


def tail_peak(samples: Column, n: int) -> Column:
    """Largest magnitude among the last n samples."""
    last = F.slice(samples, F.greatest(F.lit(1), F.size(samples) - n + 1), F.lit(n))
    return F.coalesce(F.array_max(F.transform(last, F.abs)), F.lit(0.0))


def cut(samples: Column, start_ms: Column, end_ms: Column, tail_ms: int = 200) -> Column:
    """A clip of a recording with its length and its tail's peak; it is padded where the window leaves the recording."""
    at = lambda ms: F.bround(ms * RATE / 1000).cast("int")
    clip = window(samples, at(start_ms), at(end_ms))
    return F.struct(clip.alias("clip"), (F.size(clip) / float(RATE)).alias("seconds"), tail_peak(clip, RATE * tail_ms // 1000).alias("tail_peak"))


def tail_ratio(body: Column, tail: Column) -> Column:
    """The tail's peak over the body's; null where either has no samples or the body is silent."""
    peak = lambda x: F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.when(peak(body) > 0, peak(tail) / peak(body))


def frames(samples: Column, size: int = RATE // 50) -> Column:
    """The samples in whole frames of 20 ms, in order; what is left over is dropped."""
    whole = (F.size(samples) / size).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.slice(samples, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<float>>"))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def zero_crossings(samples: Column) -> Column:
    """Share of neighbouring samples of different sign; zero is a sign of its own."""
    sign = F.transform(samples, lambda x: F.signum(x))
    pairs = F.zip_with(F.slice(sign, 1, F.greatest(F.size(sign) - 1, F.lit(0))), F.slice(sign, 2, F.greatest(F.size(sign) - 1, F.lit(0))), lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.when(F.size(samples) > 1, F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / (F.size(samples) - 1)).otherwise(0.0)


def time_features(samples: Column, short: int = RATE // 5, long: int = RATE // 2, rate: int = RATE) -> dict[str, Column]:
    """Seconds; loudness of all, the last `short`, the last `long` samples and the `long` before the last `short`; peak; crossings."""
    n = F.size(samples)
    last = lambda k: F.slice(samples, F.greatest(F.lit(1), n - k + 1), F.lit(k))
    start = F.greatest(F.lit(0), n - short - long)
    before = F.slice(samples, start + 1, F.greatest(F.lit(0), n - short - start))
    return {
        "dur": n / F.lit(float(rate)),
        "rms_all": rms(samples),
        "rms_last_short": rms(last(short)),
        "rms_last_long": rms(last(long)),
        "rms_before": rms(before),
        "peak": F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0)),
        "zcr": zero_crossings(samples),
    }


def spectral_features(x: np.ndarray, frame: int = ENERGY_FRAME) -> tuple[float, float, float]:
    """Of the last second: logs of the upper over the lower half of a windowed magnitude spectrum. Of whole frames: the
    90th over the 50th percentile of energy, and the share of frames over a tenth of the 90th and over SILENCE."""
    x = np.asarray(x, np.float64)
    if not len(x):
        return 0.0, 0.0, 0.0
    end = x[-RATE:]
    magnitude = np.abs(np.fft.rfft(end * np.hanning(len(end))))
    low, high = np.split(magnitude, [len(magnitude) // 2])
    whole = len(x) // frame
    energy = np.sqrt(np.mean(x[: whole * frame].reshape(whole, frame) ** 2, axis=1)) if whole else np.zeros(1)
    middle, loud = np.percentile(energy, [50, 90])
    return float(np.log1p(high.sum()) - np.log1p(low.sum())), float(loud / (middle + 1e-9)), float(np.mean(energy > max(loud * 0.1, SILENCE)))


@F.pandas_udf(SPECTRAL)
def spectral(samples: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([spectral_features(x) for x in samples], columns=["tilt", "p90_over_p50", "voiced_frac"])


def mel_filters(bins: int = FRAME // 2 + 1, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale and of unit area."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = 700 * (10 ** (np.linspace(0, mel(RATE / 2), mels + 2) / 2595) - 1)
    freq = np.linspace(0, RATE / 2, bins)
    low, mid, high = hertz[:-2, None], hertz[1:-1, None], hertz[2:, None]
    rise, fall = (freq - low) / (mid - low), (high - freq) / (high - mid)
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (high - low))


def log_mel(x: np.ndarray, filters: np.ndarray | None = None) -> np.ndarray:
    """(mels, frames) of the last eight seconds: mean and variance normalised, zero padding on the right, clamped logs.

    Only the real samples are normalised; padding stays zero. filters (mels x frequencies) are those a model was
    trained with; mel_filters() stands in where none are given.
    """
    x = np.asarray(x, np.float64)[-CLIP_SAMPLES:]
    clip = np.zeros(CLIP_SAMPLES)
    if len(x):
        clip[: len(x)] = (x - x.mean()) / np.sqrt(x.var() + 1e-7)
    clip = np.pad(clip, FRAME // 2, mode="reflect")
    at = np.arange(0, CLIP_SAMPLES, HOP)[:, None] + np.arange(FRAME)  # the frame that starts at the very end is left out
    power = np.abs(np.fft.rfft(clip[at] * np.hanning(FRAME + 1)[:-1], axis=1)) ** 2
    logs = np.log10(np.maximum((mel_filters() if filters is None else filters) @ power.T, 1e-10))
    return ((np.maximum(logs, logs.max() - 8) + 4) / 4).astype(np.float32)


def score(rows: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, key: str, batch: int = 64) -> DataFrame:
    """key and `probability` from a model made once per task; a value outside [0, 1] fails the job."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for part in parts:
            out = [np.asarray(model(np.stack(part[features].iloc[i : i + batch].to_list())), np.float64) for i in range(0, len(part), batch)]
            p = np.concatenate(out) if out else np.empty(0)
            if ((p < 0) | (p > 1)).any():
                raise ValueError("a probability is outside [0, 1]")
            yield pd.DataFrame({key: part[key], "probability": p})

    return rows.select(key, features).mapInPandas(work, f"{key} {dict(rows.dtypes)[key]}, probability double")


def frame_probabilities(legs: DataFrame, make_model: Callable[[], Callable[[np.ndarray, object], tuple[float, object]]], hop: int = 512) -> DataFrame:
    """leg, i, p from samples per leg by a recurrent model that maps (frame, state) to (probability, state).

    Frames of a leg depend on each other, so a leg is one row and is scored in order inside its task.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for leg, x in zip(part["leg"], part["samples"]):
                model, state, out = make_model(), None, []
                for i in range(len(x) // hop):
                    p, state = model(np.asarray(x[i * hop : (i + 1) * hop], np.float32), state)
                    out.append(float(np.float16(p)))  # thresholds act on half-precision values
                yield pd.DataFrame({"leg": leg, "i": np.arange(len(out)), "p": np.array(out, np.float64)})

    return legs.select("leg", "samples").mapInPandas(work, "leg string, i long, p double")
