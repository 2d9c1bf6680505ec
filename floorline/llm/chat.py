"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and only its own text trainable. A
conversation whose last turn is not the assistant's also gives one closing row that holds all turns and
trains nothing, so that no turn is lost.

Template: each turn reads `<|turn|>ROLE<|says|>TEXT<|end|>`. Inside roles and texts a backslash becomes
`\\e`, and `\\x` is put after the first character of every control string (the template's own and those of
common chat templates), so neither can be mistaken for markup; dropping `\\x` and then turning `\\e` back
restores the text exactly.

Defined results: null texts and roles count as empty; turns are ordered by turn, role, text, nulls first, and
repeated rows each count; an empty table gives no examples. A conversation is the unit of work: its turns
meet in one task as its digests and contexts demand, and examples are built one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that some chat template reads as markup (fixed values).
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>")
TRAINED = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\x" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\x"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), target (turn's place, null in a closing row), is_full, text, loss_start, loss_end.

    is_full marks the one row of a conversation that holds all its turns. The span is in code points of text.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == TRAINED).alias("trained"),
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    whole = whole.select("conv_id", parts.alias("parts"), F.transform("turns", lambda t: t["role"] == TRAINED).alias("trained"))
    places = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("trained", i) | (i == F.size("parts") - 1))
    rows = whole.select("conv_id", "parts", F.posexplode(places).alias("example", "at"))
    prefix = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("at")), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    last = F.get("parts", F.col("at"))
    rows = rows.select(
        "conv_id", "example", "at", (F.col("at") == F.size("parts") - 1).alias("is_full"), last.alias("last"), prefix.alias("prefix")
    )
    head = F.length("prefix") + F.length("last.head")
    trained = F.col("last.trained")
    return rows.select(
        "conv_id",
        "example",
        F.when(trained, F.col("at")).alias("target"),
        "is_full",
        F.concat("prefix", "last.head", "last.body", F.lit(END)).alias("text"),
        F.when(trained, head).alias("loss_start"),
        F.when(trained, head + F.length("last.body")).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""
    pieces = F.split(text, "<\\|end\\|>", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), SAYS, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, SAYS) + len(SAYS), F.lit(1 << 30))).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trained text and their digests, formatted size.

    Only the full row of a conversation is parsed for its turns; every other row gives its trained span alone,
    so what is grouped is in proportion to the conversation and not to its examples' contexts.
    """
    said = read_turns(F.col("text"))
    rows = formatted.select(
        "conv_id",
        "example",
        F.when(F.col("is_full"), said).alias("said"),
        F.when(
            F.col("target").isNotNull(),
            unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))),
        ).alias("trained"),
        F.length("text").cast("long").alias("chars"),
    )
    rows = rows.select(
        "conv_id",
        "example",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        "trained",
        "chars",
    )
    grouped = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda e: F.coalesce(e["trained"], F.lit(""))), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(text: str) -> str:
    text = f"replace({text}, '\\', '\\e')"
    for c in CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\x{c[1:]}')"
    return text


#: DuckDB twin of the op2 query: digests straight from the rows, formatted size from the template's lengths.
DIGEST_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {len(TURN + SAYS + END)} + length({_sql_escape("role")}) + length({_sql_escape("text")}) AS chars,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
