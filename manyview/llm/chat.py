"""Chat formatting (operator 3): heterogeneous records to canonical turns to training text.

A record is a VARIANT. Its nested field paths (the shape of ``schema_of_variant`` without
scalar types) are hashed, and the fingerprint selects one of the declared layouts; the
layout says where turns, roles and texts lie. Turns are laid out by a template whose
control strings are escaped inside roles and texts by one backslash after their first
character (an escaped string gains one more), which ``read_back`` takes away again.

The output keeps segments (text, under the loss mask or not); the formatted text is their
concatenation. DataFrame functions only. Every conversation is one row, as its formatted
text is one string; conversations are spread over tasks by id.

Defined results: null text or role counts as empty; rows of a conversation with the same
turn stand by role, then text; a null conv_id is a conversation of its own; a record whose
shape no layout declares keeps a null layout and has no turns; an empty table gives no
rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import table

HEAD, MID, TAIL = "[INST] ", " [/INST]", "</s>"
#: Strings that steer the template: <s> </s> [INST] [/INST], with any backslashes already in them.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


@dataclass(frozen=True)
class Layout:
    """``turns``: path of a list with fields ``role`` and ``text``; or else ``fields``: (role, path) in order."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: Sequence[tuple[str, str]] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def shape(self) -> str:
        if self.turns:
            return f"OBJECT<{self.turns}: ARRAY<OBJECT<{', '.join(sorted((self.role, self.text)))}>>>"
        return f"OBJECT<{', '.join(sorted(path for _, path in self.fields))}>"

    def read(self, record: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]) if self.roles else None

        def named(role: Column) -> Column:
            role = F.coalesce(role, F.lit(""))
            return F.coalesce(F.try_element_at(known, role), role) if known is not None else role

        if self.turns:
            got = F.variant_get(record, f"$.{self.turns}", f"array<struct<`{self.role}` string, `{self.text}` string>>")
            return F.transform(got, lambda t: F.struct(named(t[self.role]).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))
        each = [F.struct(F.lit(r).alias("role"), F.coalesce(F.variant_get(record, f"$.{p}", "string"), F.lit("")).alias("text")) for r, p in self.fields]
        return F.array(*each)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", "messages"),
    Layout("conversations", "conversations", "from", "value", roles=SPEAKERS),
    Layout("dialog", "dialog", "speaker", "text", roles=SPEAKERS),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def shape_of(record: Column) -> Column:
    """Nested field paths of a variant without their scalar types."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9,]+\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape_of(record))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, record VARIANT) to (conv_id, layout, turns)."""
    df = records.select("conv_id", "record", fingerprint(F.col("record")).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for x in reversed(layouts):
        hit = F.col("fingerprint") == F.xxhash64(F.lit(x.shape))
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, x.read(F.col("record"))).otherwise(turns)
    return df.select("conv_id", name.alias("layout"), turns.alias("turns"))


def format_turns(turns: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, layout, turns) to (conv_id, layout, segments, formatted)."""

    def parts(t: Column) -> Column:
        def seg(text, loss):
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(HEAD), escape(t["role"]), F.lit(MID))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"].isin(*learn)), seg(F.lit(TAIL), F.lit(False)))

    out = turns.select("conv_id", "layout", F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_chat(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    return format_turns(canonical(records, layouts), learn)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) from formatted text and its mask alone."""

    def turn(x: Column) -> Column:
        cut = F.split(x, r" \[/INST\]", 2)
        return F.struct(unescape(F.substr(cut[0], F.lit(len(HEAD) + 1))).alias("role"), unescape(cut[1]).alias("text"))

    pieces = F.split("formatted", TAIL)
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select(
        "conv_id", "formatted", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"), F.array_join(under, "").alias("loss_text")
    )


def records_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one record of the messages layout per conversation."""
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return got.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


#: The conversation the query adds; it comes in another layout.
PROBE = "</s>[INST] ok [/INST]"
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + 19 AS width FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(width)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op3_chat_format", CHAT_SQL)
def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back."""
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_variant_object(
            F.struct(F.array(*[F.struct(F.lit(r).alias("from"), F.lit(PROBE).alias("value")) for r in ("human", "gpt")]).alias("conversations"))
        ).alias("record"),
    )
    records = records_of(table(spark, sf_dir, "conversations")).unionByName(probe)
    back = read_back(format_chat(records))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
