r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; ties go by role and text, null turns come
first. Adjacent turns of a role are merged into a block, and array aggregations note where assistant texts lie. These go
over runs of ``RUN`` turns and then over the runs, so no growing array is copied once per turn:

    ### Assistant: first text<turn>second text</turn>\n

``### `` opens a block, ``</turn>\n`` closes it, ``<turn>`` parts merged texts. Inside texts and role names ``\`` is
written ``\\``, ``<`` is ``\l`` and ``#`` is ``\h`` (in names ``:`` is ``\c``), so no control string can occur there
and ``read_turns`` gets every turn back.

Null texts are empty, null roles are empty names. A conversation is one row of the result, that without id too;
repeated rows are turns of their own; an empty table gives an empty result; further columns are not read; long texts
are formatted whole. What is gathered in one row is the conversation, which is the output itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, PART = "### ", "</turn>\n", "<turn>"
ASSISTANT = "assistant"
RUN = 256  # turns that one aggregation goes over
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for mark, sign in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(mark), F.lit(sign))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def role_name(role: Column) -> Column:
    """A role in the template: capitalised if it begins with a-z, else after an equals sign."""
    capital = F.concat(F.upper(F.substring(role, 1, 1)), F.substr(role, F.lit(2)))
    name = F.when(role.rlike("^[a-z]"), capital).otherwise(F.concat(F.lit("="), role))
    return F.replace(escape(name), F.lit(":"), F.lit("\\c"))


def role_of(name: Column) -> Column:
    name = unescape(name)
    rest = F.substr(name, F.lit(2))
    return F.when(name.startswith("="), rest).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), rest))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): ``loss`` lists (start, length) in code points of the assistant's escaped texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    each = turns.select(
        "conv_id",
        F.struct(F.col("turn"), role.alias("role"), text.alias("text"), role_name(role).alias("name"), escape(text).alias("body")).alias("_turn"),
    )
    gathered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def with_control(turn: Column, i: Column) -> Column:
        same = (i > 0) & F.coalesce(F.get("_turns", i - 1)["role"] == turn["role"], F.lit(False))
        before = F.when(i > 0, F.lit(CLOSE + OPEN)).otherwise(F.lit(OPEN))
        control = F.when(same, F.lit(PART)).otherwise(F.concat(before, turn["name"], F.lit(": ")))
        return F.struct(control.alias("control"), turn["body"].alias("body"), (turn["role"] == ASSISTANT).alias("learned"))

    marked = gathered.select("conv_id", F.transform("_turns", with_control).alias("_turns"))
    spelled = marked.select("conv_id", "_turns", runs_of(F.col("_turns")).alias("_runs"))
    placed = spelled.select("conv_id", "_turns", F.transform("_runs", place_spans).alias("_placed"))
    starts = F.aggregate(
        "_placed",
        F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<bigint>").alias("starts")),
        lambda state, run: F.struct((state["next"] + run["length"]).alias("next"), F.concat(state["starts"], F.array(state["next"])).alias("starts")),
    )["starts"]

    def moved(run: Column, start: Column) -> Column:
        return F.transform(run["loss"], lambda span: F.struct((span["start"] + start).alias("start"), span["length"].alias("length")))

    pieces = F.flatten(F.transform("_turns", lambda turn: F.array(turn["control"], turn["body"])))
    return placed.select(
        "conv_id",
        F.concat(F.array_join(pieces, ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.zip_with("_placed", starts, moved)).alias("loss"),
    )


def runs_of(items: Column) -> Column:
    """An array in slices of ``RUN``."""
    last = F.greatest(F.floor((F.size(items) - 1) / F.lit(RUN)), F.lit(-1)).cast("int")
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(items, k * RUN + 1, RUN))


def place_spans(run: Column) -> Column:
    """The length of a run of turns in the output, and the assistant's texts in it, counted from its begin."""
    nothing = F.struct(F.lit(0).cast("long").alias("length"), F.array().cast(SPANS).alias("loss"))

    def add(state: Column, turn: Column) -> Column:
        begin, length = state["length"] + F.length(turn["control"]), F.length(turn["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        loss = F.when(turn["learned"], F.concat(state["loss"], span)).otherwise(state["loss"])
        return F.struct((begin + length).alias("length"), loss.alias("loss"))

    return F.aggregate(run, nothing, add)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)

    def turns_of(block: Column) -> Column:
        colon = F.instr(block, ": ")
        name = F.substr(block, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        texts = F.split(F.substr(block, colon + 2), PART, -1)
        return F.transform(texts, lambda t: F.struct(role_of(name).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped. The text is cut once per run of spans, and each span from its run's part."""

    def texts_of(run: Column) -> Column:
        start, last = F.get(run, F.lit(0))["start"], F.element_at(run, -1)
        region = F.substr(formatted, start + 1, last["start"] + last["length"] - start)
        cut = F.transform(F.array(region), lambda part: F.transform(run, lambda s: unescape(F.substr(part, s["start"] - start + 1, s["length"]))))
        return F.array_join(F.get(cut, F.lit(0)), "")

    return F.array_join(F.transform(runs_of(loss), texts_of), "")


PROBE = r"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{0}' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(PROBE.format(r"\\### Assistant: </turn> ok"))  # in Spark's literals a backslash is doubled
    done = format_conversations(rows.unionByName(probe))
    back = done.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": read_loss(F.col("formatted"), F.col("loss"))})
    newline = F.lit("\n")
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '<', '\l'), '#', '\h')"


OP10_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL {PROBE.format(r"\### Assistant: </turn> ok")}
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    replace({_sql_escaped("CASE WHEN regexp_matches(role, '^[a-z]') THEN upper(role[1]) || role[2:] ELSE '=' || role END")}, ':', '\c') AS name
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), counted AS (
  SELECT *, CASE WHEN before = role THEN {len(PART)} ELSE {len(OPEN)} + 2 + length(name) + CASE WHEN k > 1 THEN {len(CLOSE)} ELSE 0 END END
    + length({_sql_escaped("text")}) AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + {len(CLOSE)} AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""
