"""Chat formatting with schema fingerprints, in DataFrame functions only.

A record is a JSON text in any of several layouts. The fingerprint is a hash of its nested field paths, without
types and values; it selects a declarative mapping to canonical turns. A template then marks turns, escapes its own
control strings inside texts, and gives the loss mask as spans of the formatted text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
END = "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns: ``turns`` is SQL over the variant column ``v`` that gives role and text.

    ``shapes`` are sample records, one for each set of fields that the layout comes with.
    """

    name: str
    shapes: Sequence[str]
    turns: str
    roles: dict[str, str] = field(default_factory=dict)


def _listed(at: str, role: str, text: str) -> str:
    return f"transform(variant_get(v, '$.{at}', 'array<struct<{role}:string,{text}:string>>'), x -> struct(x.{role} as role, x.{text} as text))"


def _fields(**paths: str) -> str:
    given = ", ".join(f"struct('{role}' as role, variant_get(v, '$.{path}', 'string') as text)" for role, path in paths.items())
    return f"array({given})"


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"messages":[]}'), _listed("messages", "role", "content")),
    Layout("conversations", ('{"conversations":[{"from":"a","value":"b"}]}', '{"conversations":[]}'), _listed("conversations", "from", "value"), {"human": "user", "gpt": "assistant"}),
    Layout("prompt", ('{"prompt":"a","response":"b"}', '{"prompt":"a","completion":"b"}'), "array(struct('user' as role, variant_get(v, '$.prompt', 'string') as text), struct('assistant' as role, coalesce(variant_get(v, '$.response', 'string'), variant_get(v, '$.completion', 'string')) as text))"),
    Layout("instruction", ('{"instruction":"a","input":"b","output":"c"}', '{"instruction":"a","output":"c"}'), "array(struct('user' as role, concat_ws('\\n\\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), '')) as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"),
    Layout("system_prompt", ('{"system":"a","prompt":"b","response":"c"}',), _fields(system="system", user="prompt", assistant="response")),
)


def field_paths(v: Column) -> Column:
    """The nested fields of a variant without the types of its leaves; an empty or null leaf looks like any other."""
    shape = F.schema_of_variant(v)
    # a field's name is quoted where needed; leaves follow a colon, an opening bracket or nothing
    return F.regexp_replace(shape, r"(?<=^|: |<)(VOID|STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|BINARY|VARIANT|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)", "_")


def fingerprint(v: Column) -> Column:
    return F.sha2(field_paths(v), 256)


def canonical_turns(records: DataFrame, *, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint, layout, turns`` to ``records``.

    Null texts and roles in a turn become empty. Records that are no JSON, or whose fingerprint no layout has, get
    a null layout and null turns, so that a caller can count and add them; nothing is dropped. An empty list of
    messages gives no turns.
    """
    spark = records.sparkSession
    samples = [(x.name, s) for x in layouts for s in x.shapes]
    known = spark.createDataFrame(samples, "layout string, shape string").select("layout", fingerprint(F.parse_json("shape")).alias("fingerprint"))
    marks: dict[str, list[str]] = {}
    for r in known.collect():  # a row for each declared shape
        marks.setdefault(r["layout"], []).append(r["fingerprint"])
    v = F.try_parse_json(F.col(record_col))
    out = records.withColumn("v", v).withColumn("fingerprint", fingerprint(F.col("v")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        own = F.col("fingerprint").isin(*marks[x.name])
        raw = F.expr(x.turns).cast(TURNS)
        clean = F.transform(raw, _cleaner(x.roles))
        layout, turns = F.when(own, F.lit(x.name)).otherwise(layout), F.when(own, clean).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("v")


def _cleaner(roles: dict[str, str]):
    def clean(t: Column) -> Column:
        role = F.coalesce(*(F.when(t["role"] == a, F.lit(b)) for a, b in roles.items()), t["role"], F.lit(""))
        return F.struct(role.alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return clean


def escaped(text: Column) -> Column:
    """Reversible: a backslash is doubled, and one is put inside each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<turn"), F.lit("<\\turn"))
    return F.replace(text, F.lit("</turn"), F.lit("<\\/turn"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role in a marker must not end the marker."""
    return F.replace(escaped(role), F.lit(">"), F.lit("\\>"))


def formatted(turns: Column) -> Column:
    """``<turn ROLE>`` newline TEXT ``</turn>`` newline for each turn; no turns give an empty text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<turn "), _role(t["role"]), F.lit(">\n"), escaped(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, trained: Sequence[str] = ("assistant",)) -> Column:
    """Start (from 0) and length in code points of each trained turn's text within the formatted one."""
    def step(acc, t):
        head = F.length(_role(t["role"])) + F.lit(len("<turn >\n"))
        body = F.length(escaped(t["text"]))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length"))
        spans = F.when(t["role"].isin(*trained), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + F.lit(len(END))).cast("int").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_records(records: DataFrame, *, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """``canonical_turns`` and ``formatted, loss_spans``; both null where no layout fits."""
    out = canonical_turns(records, record_col=record_col, layouts=layouts)
    return out.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns"), trained))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(text, r"</turn>\n"), lambda p: p != "")
    def turn(p):
        role = F.regexp_extract(p, r"(?s)^<turn ((?:[^\\>]|\\.)*)>\n", 1)
        body = F.substring(p, F.length(role) + F.lit(len("<turn >\n") + 1), F.length(p))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))
    return F.transform(parts, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, record``: each conversation as one JSON record, in the layout that its roles and id call for.

    Rows go by turn, then role and text; null texts and roles are empty. A user and an assistant row make a
    prompt or an instruction record, others a list of messages in one of two layouts. Rows of a null conv_id are
    one conversation.
    """
    rows = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    m, even = F.col("m"), F.coalesce(F.col("conv_id"), F.lit(0)) % 2 == 0
    is_pair = (F.size(m) == 2) & (m[0]["role"] == "user") & (F.element_at(m, -1)["role"] == "assistant")
    safe = F.forall(m, lambda x: ~x["role"].isin("human", "gpt"))
    messages = F.to_json(F.struct(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    said = lambda x: F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("gpt")).otherwise(x["role"])
    shared = F.to_json(F.struct(F.transform(m, lambda x: F.struct(said(x).alias("from"), x["text"].alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(m[0]["text"].alias("prompt"), F.element_at(m, -1)["text"].alias("response")))
    instruction = F.to_json(F.struct(m[0]["text"].alias("instruction"), F.element_at(m, -1)["text"].alias("output")))
    record = F.when(is_pair & even, prompt).when(is_pair, instruction).when(even | ~safe, messages).otherwise(shared)
    return grouped.select("conv_id", record.alias("record"))
