"""Chat formatting with Spark expressions only.

Turns are collected as structs in runs of ``CHUNK`` turn numbers, sorted and merged into blocks of adjacent turns of one
role; a run sees the roles at its edges and the length of what is before it through a window over the runs of
its conversation. The runs of a conversation are then concatenated. All of it is linear in the number of turns:

    <s>[ROLE]role[/ROLE]text[SEP]text</s>...

Every turn stays apart inside its block, so the output reads back to the very
turns that went in. Control strings inside texts and roles, the template's own and
those of other common templates, get an escape sign after their first character.
The loss mask is a list of character spans, one for each assistant turn's text.

Nulls and edges: a null text or role counts as empty; turns with equal numbers are
ordered by role, then text; a null turn number comes first; rows with a null
conversation form one conversation; repeated rows are repeated turns; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 32
OPEN, BODY, BETWEEN, CLOSE = "<s>[ROLE]", "[/ROLE]", "[SEP]", "</s>"
SIGN = "␛"
#: First characters and rests of the control strings, as regular expressions.
_FIRST = r"(<|\[)"
_REST = r"(/?s>|/?ROLE\]|SEP\]|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(SIGN), F.lit(SIGN + "e")), _FIRST + _REST, "$1" + SIGN + "$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _FIRST + SIGN + _REST, "$1$2"), F.lit(SIGN + "e"), F.lit(SIGN))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (start from 0, length) of each conversation."""
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.floor(F.col(f"`{turn}`") / CHUNK).alias("chunk"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    runs = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    order = Window.partitionBy("conv_id").orderBy("chunk")
    runs = runs.withColumns({
        "before": F.lag(F.element_at("turns", -1)["role"]).over(order),
        "after": F.lead(F.col("turns")[0]["role"]).over(order),
    })

    # A turn opens a block unless the one before it has the same role, and closes one unless the next has.
    def piece(t: Column, i: Column) -> Column:
        previous = F.when(i == 0, F.col("before")).otherwise(F.get("turns", i - 1)["role"])
        following = F.coalesce(F.get("turns", i + 1)["role"], F.col("after"))
        head = F.when(previous.eqNullSafe(t["role"]), BETWEEN).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY)))
        return F.struct(
            (t["role"] == "assistant").alias("learn"),
            head.alias("head"),
            escape(t["text"]).alias("text"),
            F.when(following.eqNullSafe(t["role"]), "").otherwise(CLOSE).alias("tail"),
        )

    runs = runs.select("conv_id", "chunk", F.transform("turns", piece).alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    runs = runs.withColumn("formatted", joined)
    ahead = F.coalesce(F.sum(F.length("formatted")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    runs = runs.withColumn("at", ahead)

    def span(state: Column, p: Column) -> Column:
        begin = (state["at"] + F.length(p["head"])).cast("bigint")
        own = F.array(F.struct(begin.alias("start"), F.length(p["text"]).cast("bigint").alias("length")))
        return F.struct(
            (begin + F.length(p["text"]) + F.length(p["tail"])).cast("bigint").alias("at"),
            F.when(p["learn"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.col("at").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate("pieces", start, span, lambda state: state["spans"])
    runs = runs.select("conv_id", F.struct("chunk", "formatted", spans.alias("spans")).alias("run"))
    chats = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("runs", lambda r: r["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("runs", lambda r: r["spans"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.split(formatted, _literal(CLOSE), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(OPEN) + 1, 1 << 30), _literal(BODY), 2)
        return F.transform(
            F.split(parts[1], _literal(BETWEEN), -1),
            lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
