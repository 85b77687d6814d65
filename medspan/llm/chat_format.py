"""Chat formatting by event sourcing, in DataFrame operations only: logs are folded into final messages, then rendered.

A log has rows (conv_id, seq, message, kind, role, text). `open` begins a message and names its role, `delta` adds text to it, `edit`
puts a text in place of what it held, and `regenerate` throws the message away with all later ones of its conversation, so that
what follows builds them anew. Conversations are dealt by conv_id, once; within one, the last regeneration of a message or of one
before it is a running maximum over the messages, and the last edit since then a maximum over the message. What is left of the
deltas is joined in order of seq. All of it is windows and grouping over one exchange; nothing is compared in pairs.

A message is rendered as mark, role, mark, text, mark. Control strings inside roles and texts are broken by a backslash after their
first letter, and backslashes are doubled, so that no text can close its turn and reading gives back exactly what was written.
The loss mask is the span of each assistant's escaped text, in code points of the whole conversation.

Null texts and roles are empty, null conversations are one conversation. An event that was delivered twice counts once; of several
events with one seq, texts go in order. A message of which no event is left is not there; conversations without messages are not
either. Of a role, the one that was named last counts. Extra columns are ignored. Very long texts and conversations of many turns
take time in proportion; a conversation is one row in the end, as its rendering is one text. An empty log gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medspan.llm.common import table

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
LEARNED = "assistant"


@dataclass(frozen=True)
class Template:
    """Marks before the role, after it, and after the text; `controls` are all strings that no text may hold as they are."""

    open: str = "<|im_start|>"
    head: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    after: str = "\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self):
        if not {self.open, self.head, self.close} <= {*self.controls} or any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("marks are control strings, of two letters or more, without backslashes")

    def escape(self, x: Column) -> Column:
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), heads, r"$0\\")

    @staticmethod
    def unescape(x: Column) -> Column:
        return F.regexp_replace(x, r"\\(\\)?", "$1")


TEMPLATE = Template()


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: what is left of a log."""
    own = Window.partitionBy("conv_id", "message")
    upto = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = lambda kind, more=F.lit(True): F.when((F.col("kind") == kind) & more, F.col("seq"))
    least = F.lit(-(2**63)).cast("long")
    rows = log.select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cut", F.coalesce(F.max(since("regenerate")).over(upto), least))
    named = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own)["role"]
    rows = rows.withColumns({"role": named, "edited": F.coalesce(F.max(since("edit", F.col("seq") >= F.col("cut"))).over(own), least)})
    alive = rows.filter(F.col("seq") >= F.greatest("cut", "edited"))
    spoken = F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", "text"))
    parts = F.sort_array(F.collect_set(spoken))
    return alive.groupBy("conv_id", "message").agg(F.first("role").alias("role"), parts.alias("parts")).select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted, turns: for each turn, where its piece begins and, if a model learns from it, the span that it learns."""
    piece = F.concat(F.lit(template.open), "role", F.lit(template.head), "text", F.lit(template.close + template.after))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    learned = F.col("role") == LEARNED
    rows = messages.select("conv_id", "message", learned.alias("learned"), template.escape(F.col("role")).alias("role"), template.escape(F.col("text")).alias("text"))
    rows = rows.withColumns({"piece": piece, "n": F.length("text"), "skip": F.length("role") + len(template.open) + len(template.head)}).withColumn("size", F.length("piece"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    start = F.when(F.col("learned"), F.col("at") + F.col("skip"))
    turn = F.struct("at", start.alias("loss_start"), (start + F.col("n")).alias("loss_end"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "piece", turn.alias("turn")))).alias("all"))
    return whole.select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.transform("all", lambda x: x["turn"]).alias("turns"))


def read_back(rendered: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learned: what a rendering says, and the text under its loss mask, without escapes."""
    pieces = F.slice(F.split("formatted", re.escape(template.open)), 2, 2**30)
    lead, tail = len(template.open), len(template.close + template.after)

    def turn(x: Column) -> Column:
        piece, span = x["piece"], x["turn"]
        role = F.substring_index(piece, template.head, 1)
        first = F.length(role) + len(template.head)
        said = F.substring(piece, first + 1, F.length(piece) - first - tail)
        under = F.substring(piece, (span["loss_start"] - span["at"] - lead + 1).cast("int"), (span["loss_end"] - span["loss_start"]).cast("int"))
        return F.struct(template.unescape(role).alias("role"), template.unescape(said).alias("text"), template.unescape(under).alias("learned"))

    each = F.transform(F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("turn")), turn)
    rows = rendered.select("conv_id", "formatted", each.alias("each"))
    return rows.select("conv_id", "formatted", F.transform("each", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.array_join(F.transform("each", lambda x: x["learned"]), "").alias("learned"))


def replayed(rows: DataFrame) -> DataFrame:
    """A log that ends in the given rows (conv_id, turn, role, text), one message a row by turn: texts stream in three deltas, and by
    a hash of the row some are drafted and regenerated, some edited, and some regenerated after the next message has begun."""
    within = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = plain.select("conv_id", "role", "text", F.row_number().over(within).cast("long").alias("message"))
    third = F.floor(F.length("text") / 3).cast("int")
    parts = numbered.select("*", F.substring("text", F.lit(1), third).alias("a"), F.substring("text", third + 1, third).alias("b"), F.substring("text", 2 * third + 1, F.length("text")).alias("c"))
    none = F.lit(None).cast("string")
    event = lambda kind, text, ahead=0, role=none: F.struct((F.col("message") + ahead).alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    a, b, c = (F.col(x) for x in "abc")
    opened, streamed = event("open", none, role=F.col("role")), [event("delta", x) for x in (a, b, c)]
    ways = (
        [opened, *streamed],
        [opened, event("delta", b), event("regenerate", none), *streamed],
        [opened, event("delta", c), event("edit", a), *streamed[1:]],
        [opened, streamed[0], event("open", none, 1, F.lit("draft")), event("delta", a, 1), event("regenerate", none), *streamed],
    )
    way = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("message").cast("string")).cast("binary")), F.lit(4))
    log = F.when(way == 0, F.array(*ways[0])).when(way == 1, F.array(*ways[1])).when(way == 2, F.array(*ways[2])).otherwise(F.array(*ways[3]))
    each = parts.select("conv_id", F.col("message").alias("row"), F.posexplode(log).alias("i", "e"))
    return each.select("conv_id", (F.col("row") * 16 + F.col("i")).alias("seq"), "e.message", "e.kind", "e.role", "e.text")


TRAP = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit(LEARNED))).alias("turn", "role"), F.lit(TRAP).alias("text"))
    back = read_back(render(fold(replayed(rows.unionByName(trap)))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FOUND = lambda x: " + ".join([f"(length({x}) - length(replace({x}, {_sql_literal(c)}, ''))) // {len(c)}" for c in (*TEMPLATE.controls, "\\")])
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_sql_literal(TRAP)} UNION ALL SELECT -1, 1, '{LEARNED}', {_sql_literal(TRAP)}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {_FOUND("role")} + {_FOUND("text")} + {sum(map(len, (TEMPLATE.open, TEMPLATE.head, TEMPLATE.close, TEMPLATE.after)))}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
