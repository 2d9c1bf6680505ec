"""Secret scan in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy.

Patterns give the spans `assign`, `access` and `hex`. Their matches are then blanked, and every maximal run of 20 or
more characters of the base-64 alphabet in what is left is a candidate, so the uncovered rest of a run beside a
pattern's span is one too. A window of 20 characters slides over a candidate; counts per character are kept by adding
the entering and taking off the leaving character, and the entropy follows from the running sum of c * log2(c). Each
class of characters has its threshold: windows of hexadecimal digits with letters and figures among them, and windows
of any base-64 characters. A candidate is a span of kind `entropy`, or `letters` if it has no digit, if a window of
some class reaches that class's threshold, unless the allow-list (UUIDs, runs of one letter case or of digits, words
and numbers joined by marks or by capitals, known dummy words) suppresses it. The allow-list looks at a candidate
without the marks at its ends.

A candidate's characters are taken apart once and every step costs the same, so the time is linear in a run's length;
no pattern backtracks or recurses over a run; matches are gathered in parts and texts put together from bytes, so many
secrets in one text do not copy it again and again. Positions come from the alternation of split and match lengths, in code
points, end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; an empty table
gives no rows; other columns are left alone, but columns that bear the names of the two results are replaced. Nothing
crosses rows, so nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Kinds in the order that breaks ties of start (fixed values).
KINDS = ("assign", "access", "hex", "entropy", "letters")
ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
#: Runs are maximal, so a least length in the pattern drops the same matches as a later test.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Figures first, then hexadecimal letters, then the rest of base-64; and the thresholds in bits a character.
ALPHABET = "0123456789" + "abcdefABCDEF" + "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
FIGURES, HEXADECIMAL = 10, 22
LEAST = {"hexadecimal": 3.0, "base64": 3.6}
#: Possessive, so that the matcher neither backtracks nor recurses over long runs.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9_=+/-]++$",
    "^(?:[a-z]++|[A-Z]++)$",
    "^(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+|[0-9]++)(?:[-_/=+]++(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+|[A-Z]++|[0-9]++))*+$",
    "(?i)(?:example|placeholder|0123456789|abcdefghij|xxxxxxxx)",
)
PLACEHOLDER = "<SECRET>"
#: Stands for a character under a pattern's span; of no class.
BLANK = " "
#: Matches of a text that are gathered at once.
CHUNK = 256


def _length(x: Column) -> Column:
    return F.length(x).cast("long")


def _bind(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    """Array of (gap, hit): the text as its pieces between matches and the matches, left to right."""
    gaps = F.split(text, pattern, -1)
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def _chunks(items: Column) -> Column:
    """The array in parts of CHUNK: what is added item by item to an array of its own stays short."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def _before(sums: Column, zero: Column, add) -> Column:
    """For each of a few values what `add` makes of all before it."""
    empty = F.filter(F.array(zero), lambda _: F.lit(False))
    step = lambda acc, x: F.struct(add(acc["now"], x).alias("now"), F.concat(acc["list"], F.array(acc["now"])).alias("list"))
    return F.aggregate(sums, F.struct(zero.alias("now"), empty.alias("list")), step, lambda acc: acc["list"])


def _spans(text: Column, pattern: str, kind: int, passes=None) -> Column:
    """Array of (start, order, end, value, byte) of the pattern's matches, left to right; byte is where start is in UTF-8."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string,byte:bigint>>")
    bytes_ = lambda x: F.coalesce(F.octet_length(x).cast("long"), F.lit(0).cast("long"))
    chars = lambda x: F.coalesce(_length(x), F.lit(0).cast("long"))
    place = lambda at, byte: F.struct(at.alias("at"), byte.alias("byte"))
    add = lambda a, b: place(a["at"] + b["at"], a["byte"] + b["byte"])
    zero = place(F.lit(0).cast("long"), F.lit(0).cast("long"))

    def step(acc, p):
        start, byte = acc["at"] + _length(p["gap"]), acc["byte"] + bytes_(p["gap"])
        end = start + chars(p["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("value"), byte.alias("byte"))
        found = F.when(p["hit"].isNotNull(), F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (byte + bytes_(p["hit"])).alias("byte"), found.alias("found"))

    def located(chunks):
        size = lambda c: F.aggregate(c, zero, lambda a, p: place(a["at"] + chars(p["gap"]) + chars(p["hit"]), a["byte"] + bytes_(p["gap"]) + bytes_(p["hit"])))
        inside = lambda c, z: F.aggregate(c, F.struct(z["at"].alias("at"), z["byte"].alias("byte"), empty.alias("found")), step, lambda acc: acc["found"])
        return F.flatten(F.zip_with(chunks, _before(F.transform(chunks, size), zero, add), inside))

    found = F.when(F.regexp_like(text, F.lit(pattern)), _bind(_bind(_parts(text, pattern), _chunks), located)).otherwise(empty)
    return F.filter(found, passes) if passes else found


def _blanked(text: Column, pattern: str, passes=None) -> Column:
    """The text with BLANK for every character of a match that passes; positions stay as they are."""

    def piece(p):
        hit = F.coalesce(p["hit"], F.lit(""))
        gone = F.repeat(F.lit(BLANK), F.length(hit))
        return F.concat(p["gap"], F.when(passes(hit), gone).otherwise(hit) if passes else gone)

    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(F.transform(_parts(text, pattern), piece), "")).otherwise(text)


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """Struct of the largest entropy of a window of `width` characters: `hexadecimal` and `base64`.

    A window counts for a class if all its characters are of it, and for `hexadecimal` if letters and figures are among
    them; -1 for a class without such a window. Characters outside the alphabet count as one more symbol of no class.
    """
    place = [0] * 128
    for at, c in enumerate(ALPHABET, 1):
        place[ord(c)] = at
    letter = lambda c: F.coalesce(F.get(F.lit(place), F.ascii(c)), F.lit(0)) + 1
    # what a symbol's next occurrence adds to the sum of c * log2(c), by its count so far
    gain = F.lit([(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    n, full = len(ALPHABET) + 1, float(width)

    def paired(codes):
        """(new, old): the entering and the leaving symbol of every step; old is 0 until the window is full."""
        return F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(0)).alias("old"), (i >= width - 1).alias("whole")))

    # counts are letters of a string, 'A' for none: one place is read and overwritten without copying an array of boxes
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 65
    put = lambda counts, at, c: F.overlay(counts, F.char(c + 65), at, F.lit(1))
    one = lambda test: F.when(test, 1).otherwise(0)
    symbol = lambda c: (c > 1) & (c <= FIGURES + 1)
    hex_letter = lambda c: (c > FIGURES + 1) & (c <= HEXADECIMAL + 1)
    foreign = lambda c: c == 1

    def step(acc, p):
        new, old = p["new"], p["old"]
        added = F.struct(
            put(acc["counts"], new, count(acc["counts"], new) + 1).alias("counts"),
            (acc["total"] + F.get(gain, count(acc["counts"], new))).alias("total"),
        )
        taken = lambda a: F.struct(
            put(a["counts"], old, count(a["counts"], old) - 1).alias("counts"),
            (a["total"] - F.get(gain, count(a["counts"], old) - 1)).alias("total"),
        )
        same = F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"))
        now = F.when(new == old, same).otherwise(F.when(old > 0, _bind(added, taken)).otherwise(added))
        keep = lambda test, name: (acc[name] + one(test(new)) - one((old > 0) & test(old))).alias(name)
        moved = F.struct(now.alias("now"), keep(symbol, "figures"), keep(hex_letter, "letters"), keep(foreign, "foreign"))

        def scored(m):
            entropy = F.lit(math.log2(full)) - m["now"]["total"] / full
            hexadecimal = p["whole"] & (m["figures"] + m["letters"] == width) & (m["figures"] > 0) & (m["letters"] > 0)
            return F.struct(
                m["now"]["counts"].alias("counts"),
                m["now"]["total"].alias("total"),
                *(m[c].alias(c) for c in ("figures", "letters", "foreign")),
                F.when(hexadecimal, F.greatest(acc["hexadecimal"], entropy)).otherwise(acc["hexadecimal"]).alias("hexadecimal"),
                F.when(p["whole"] & (m["foreign"] == 0), F.greatest(acc["base64"], entropy)).otherwise(acc["base64"]).alias("base64"),
            )

        return _bind(moved, scored)

    zero = F.lit(0)
    start = F.struct(
        F.lit("A" * n).alias("counts"), F.lit(0.0).alias("total"), zero.alias("figures"), zero.alias("letters"), zero.alias("foreign"),
        F.lit(-1.0).alias("hexadecimal"), F.lit(-1.0).alias("base64"),
    )
    best = lambda acc: F.struct(acc["hexadecimal"].alias("hexadecimal"), acc["base64"].alias("base64"))
    codes = F.transform(F.split(value, ""), letter)
    return F.aggregate(_bind(codes, paired), start, step, best)


def _candidate(span: Column) -> Column:
    inner = F.regexp_replace(span["value"], "^[-_/=+]++|(?<![-_/=+])[-_/=+]++$", "")
    allowed = lambda v: F.array_max(F.array(*(F.regexp_like(v, F.lit(pattern)) for pattern in ALLOWED)))
    high = lambda e: (e["hexadecimal"] >= LEAST["hexadecimal"]) | (e["base64"] >= LEAST["base64"])
    return F.when(_bind(inner, allowed), False).otherwise(_bind(window_entropy(span["value"]), high))


def _by_digits(span: Column) -> Column:
    """The span, of kind `letters` if it has no digit."""
    kind = F.when(F.regexp_like(span["value"], F.lit("[0-9]")), 3).otherwise(4)
    return F.struct(span["start"].alias("start"), kind.alias("kind"), span["end"].alias("end"), span["value"].alias("value"), span["byte"].alias("byte"))


def scan(documents: DataFrame, base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """documents with the columns `base` and `spans`: arrays of (start, kind, end, value), sorted.

    kind is a place in KINDS; `spans` holds those of `base` and the method's.
    """
    text = F.coalesce("text", F.lit(""))
    chars = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    patterns = F.array_sort(F.concat(_spans(text, ASSIGN, 0, lambda s: chars(s["value"])), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    rest, runs = (common.fresh(documents, n) for n in ("secret_rest", "secret_runs"))
    found = documents.withColumn(base, patterns)
    blanks = (_blanked(text, ASSIGN, chars), _blanked(text, ACCESS), _blanked(text, HEX))
    either = lambda a, b: F.when(a == BLANK, a).otherwise(b)
    letters = [F.split(b, "") for b in blanks]
    every = F.array_join(F.zip_with(F.zip_with(letters[0], letters[1], either), letters[2], either), "")
    kinds = F.array_distinct(F.transform(F.col(base), lambda s: s["kind"]))
    only = lambda k: F.when(F.get(kinds, F.lit(0)) == k, blanks[k])
    bare = F.when(F.size(kinds) > 1, every).otherwise(F.coalesce(*(only(k) for k in range(3)), text))
    found = found.withColumn(rest, bare)
    found = found.withColumn(runs, F.transform(F.filter(_spans(F.col(rest), CANDIDATE, 3), _candidate), _by_digits))
    return found.withColumn(spans, F.array_sort(F.concat(base, runs))).drop(rest, runs)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span's characters replaced by PLACEHOLDER; overlapping spans merge; other texts and columns as they were."""
    base, spans = common.fresh(documents, "secret_base"), common.fresh(documents, "secret_spans")
    found = scan(documents, base, spans)
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    cut = lambda t, low, high: F.decode(F.substring(t, (low + 1).cast("int"), (high - low).cast("int")), "utf-8")
    end = lambda s: s["byte"] + s["end"] - s["start"]  # noqa: E731  matches are ASCII

    def cleaned(t):
        def step(acc, s):
            fresh = s["byte"] >= acc["at"]
            out = F.when(fresh, F.concat(acc["out"], cut(t, acc["at"], s["byte"]), F.lit(PLACEHOLDER))).otherwise(acc["out"])
            return F.struct(out.alias("out"), F.greatest(acc["at"], end(s)).alias("at"))

        def joined_parts(chunks):
            ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, end)))
            inside = lambda c, at: F.aggregate(c, F.struct(F.lit("").alias("out"), at.alias("at")), step, lambda acc: acc["out"])
            parts = F.zip_with(chunks, _before(ends, F.lit(0).cast("long"), F.greatest), inside)
            return F.concat(F.array_join(parts, ""), cut(t, F.array_max(ends), F.length(t)))

        return _bind(_chunks(F.col(spans)), joined_parts)

    return found.withColumn("text", F.when(F.size(spans) > 0, _bind(raw, cleaned)).otherwise(F.col("text"))).drop(base, spans)
