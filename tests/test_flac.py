"""The coder against a decoder written from the format's description."""

import hashlib

import numpy as np
import pytest

from floorline.sources import flac


class Bits:
    def __init__(self, data):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n):
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if x >> (n - 1) else x

    def unary(self):
        n = int(np.argmax(self.bits[self.at :]))
        self.at += n + 1
        return n


def remainder(data, width, poly):
    """The check sum bit by bit."""
    crc = 0
    for bit in np.unpackbits(np.frombuffer(data, np.uint8)).tolist():
        crc = (crc << 1 | bit)
        if crc >> width:
            crc ^= 1 << width | poly
    for _ in range(width):
        crc <<= 1
        if crc >> width:
            crc ^= 1 << width | poly
    return crc


def decode(data):
    assert data[:8] == b"fLaC\x80\x00\x00\x22"
    info = Bits(data[8:26])
    assert (info.take(16), info.take(16), info.take(48)) == (4096, 4096, 0)
    rate, channels, depth, total = info.take(20), info.take(3) + 1, info.take(5) + 1, info.take(36)
    assert (channels, depth) == (1, 16)
    out, at, number = [], 42, 0
    while at < len(data):
        b = Bits(data[at:])
        assert b.take(16) == 0xFFF8 and b.take(16) == 0x7008
        lead = b.take(8)
        more = 0 if lead < 128 else 8 - len(bin(~lead & 0xFF)[2:]) - 1
        n = lead if not more else lead & (0x3F >> more)
        for _ in range(more):
            n = n << 6 | b.take(8) & 0x3F
        size = b.take(16) + 1
        head = b.at // 8
        assert n == number and b.take(8) == remainder(data[at : at + head], 8, 0x07)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        if kind == 1:
            x = [b.signed(16) for _ in range(size)]
        else:
            order = kind - 8
            assert 0 <= order <= 4
            x = [b.signed(16) for _ in range(order)]
            assert b.take(6) == 0
            k = b.take(4)
            for _ in range(size - order):
                folded = b.unary() << k | b.take(k)
                r = -(folded + 1) // 2 if folded & 1 else folded // 2
                guess = [lambda: 0, lambda: x[-1], lambda: 2 * x[-1] - x[-2], lambda: 3 * x[-1] - 3 * x[-2] + x[-3], lambda: 4 * x[-1] - 6 * x[-2] + 4 * x[-3] - x[-4]][order]()
                x.append(guess + r)
        end = at + -(-b.at // 8)
        assert int.from_bytes(data[end : end + 2], "big") == remainder(data[at:end], 16, 0x8005)
        out += x
        at, number = end + 2, number + 1
    assert len(out) == total and hashlib.md5(np.array(out, "<i2").tobytes()).digest() == data[26:42]
    return rate, np.array(out)


@pytest.mark.parametrize("kind", ["empty", "one", "two", "silence", "noise", "tone", "edges", "steps"])
def test_stream_round_trip(kind):
    rng = np.random.default_rng(1)
    t = np.arange(9000)
    x = {
        "empty": t[:0], "one": np.array([-5]), "two": np.array([32767, -32768]), "silence": 0 * t, "noise": rng.integers(-32768, 32768, 5000),
        "tone": np.rint(9000 * np.sin(t / 40)).astype(int), "edges": np.tile([32767, -32768], 3000), "steps": np.repeat(rng.integers(-300, 300, 50), 100),
    }[kind]
    coded = flac.encode(x)
    rate, got = decode(coded)
    assert rate == 16_000 and np.array_equal(got, x)
    if kind in ("silence", "tone", "steps"):
        assert len(coded) < len(x)


def test_numbers_of_later_frames():
    assert [flac._coded_number(n) for n in (0, 127, 128, 2047, 2048, 65_535, 65_536)] == [chr(n).encode("utf-8", "surrogatepass") for n in (0, 127, 128, 2047, 2048, 65_535, 65_536)]


def test_column(spark):
    df = spark.createDataFrame([([0.5, -2.0, 0.25],)], "x array<float>")
    assert decode(df.select(flac.flac_bytes("x")).first()[0])[1].tolist() == [16384, -32767, 8192]
