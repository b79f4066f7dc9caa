"""Chat formatting: records of unlike layouts become canonical turns, then one marked text.

A record's layout is known by a fingerprint, the SHA-256 of its nested field paths; it
selects a declarative mapping to (role, text) turns. Everything runs as Spark
expressions. Tables are mapped as they are, by the fingerprint of their schema; only JSON
records, whose layouts differ from row to row, are parsed.

The template writes a turn as ``### role:``, line feed, text, ``</turn>``, line feed.
Inside roles and texts a backslash becomes ``\\e``, the turn end ``\\t``, the header
mark ``\\h`` and, in roles, a line feed ``\\n``; so no mark ever stands inside a text
and reading back is exact.

Defined results: null texts and roles are empty, a null turn number is 0; turns with an
equal turn number are ordered by role, then text; repeated rows are turns of their own; a
null conversation id is a conversation too. A record whose fingerprint has no mapping gives
null turns, a table of such a schema is an error; an empty conversation gives an empty text
and an empty table an empty result. A conversation is one value, as its text is: all of its
turns meet in one task. Spark can't parse a JSON text of 20 million characters or a record
of more than its variant limit: such a record fails the query.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from profilis.llm.common import scanned

HEAD, END = "### ", "</turn>\n"

#: Layout: shape of its field paths, and the turns it stands for as a Spark expression.
MAPPINGS: dict[str, tuple[str, str]] = {
    "rows": ("{turns:[{role,text,turn}]}", "transform(turns, x -> struct(x.role as role, x.text as text))"),
    "messages": ("{messages:[{content,role}]}", "transform(messages, x -> struct(x.role as role, x.content as text))"),
    "from_value": ("{conversations:[{from,value}]}", "transform(conversations, x -> struct(case x.from when 'human' then 'user' when 'gpt' then 'assistant' else x.from end as role, x.value as text))"),
    "instruction": ("{instruction,output}", "array(struct('user' as role, instruction as text), struct('assistant' as role, output as text))"),
    "instruction_input": (
        "{input,instruction,output}",
        "array(struct('user' as role, concat(coalesce(instruction, ''), if(coalesce(input, '') = '', '', concat('\\n\\n', input))) as text), struct('assistant' as role, output as text))",
    ),
    "prompt_response": ("{prompt,response}", "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
    "prompt_completion": ("{completion,prompt}", "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))"),
    "question_answer": ("{answer,question}", "array(struct('user' as role, question as text), struct('assistant' as role, answer as text))"),
    "system_prompt_response": ("{prompt,response,system}", "array(struct('system' as role, system as text), struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
}
#: All fields that mappings read.
FIELDS = (
    "turns array<struct<role:string,text:string,turn:bigint>>, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
    "instruction string, input string, output string, prompt string, response string, completion string, question string, answer string, system string"
)
#: Bytes from which on a JSON record that isn't understood is an error.
LONG = 16 << 20
SCALARS = "STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\\(\\d+,\\d+\\)"


def shape(json_text: Column) -> Column:
    """Nested field paths of a JSON record, without the types of scalars."""
    kind = F.schema_of_variant(F.try_parse_json(json_text))
    bare = F.regexp_replace(kind, f": (?:{SCALARS})(?=[,>])", "")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "ARRAY<OBJECT<([^<>]*)>>", "[{$1}]"), "OBJECT<([^<>]*)>", "{$1}"), " ", "")
    return marked


def schema_shape(kind: DataType) -> str:
    """The same of a Spark type."""
    if isinstance(kind, StructType):
        parts = ((f.name, schema_shape(f.dataType)) for f in sorted(kind, key=lambda f: f.name))
        return "{" + ",".join(f"{name}:{inner}" if inner else name for name, inner in parts) + "}"
    return f"[{schema_shape(kind.elementType)}]" if isinstance(kind, ArrayType) else ""


def fingerprint(of_shape: str) -> str:
    return hashlib.sha256(of_shape.encode()).hexdigest()


def to_turns(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null if unknown) and ``turns``."""
    known = records.withColumn("fingerprint", F.sha2(shape(F.col(json_col)), 256)).withColumn("__r", F.from_json(json_col, FIELDS))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (of_shape, rule) in MAPPINGS.items():
        here = F.col("fingerprint") == fingerprint(of_shape)
        layout, turns = F.when(here, F.lit(name)).otherwise(layout), F.when(here, F.expr(_on_record(rule))).otherwise(turns)
    # below LONG bytes nothing is too long for the parsers, and null turns are of no mapping
    lost = (F.octet_length(json_col) > LONG) & F.when(layout.isNotNull(), turns.isNull()).otherwise(F.try_parse_json(F.col(json_col)).isNull())
    turns = F.when(lost, F.raise_error(F.lit("a chat record is too long to be parsed"))).otherwise(turns)
    return known.withColumn("layout", layout).withColumn("turns", turns).withColumn("turns", _filled(F.col("turns"))).drop("__r")


def _filled(turns: Column) -> Column:
    return F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))


def _on_record(rule: str) -> str:
    """Reads the mapping's top-level fields from the parsed record."""
    fields = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]
    import re

    return re.sub(rf"(?<![\w.'])({'|'.join(fields)})(?![\w'])", r"__r.\1", rule)


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(c, F.lit("</turn>"), F.lit("\\t")), F.lit("###"), F.lit("\\h"))


def unescaped(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\t"), F.lit("</turn>")), F.lit("\\h"), F.lit("###"))
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: where assistant texts stand in it (code points, end exclusive)."""
    head = lambda x: F.concat(F.lit(HEAD), F.replace(escaped(x["role"]), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))
    pieces = F.transform(turns_col, lambda x: F.struct(head(x).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == "assistant").alias("learn")))
    df = df.withColumn("__p", pieces)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["head"])
        end = begin + F.length(x["body"])
        return end + len(END), F.when(x["learn"], F.struct(begin.alias("start"), end.alias("end")))

    text = F.array_join(F.transform("__p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    # where each turn begins, by a running sum of lengths
    spans = scanned(F.col("__p"), F.lit(0).cast("bigint"), "struct<start:bigint,end:bigint>", step)
    return df.withColumn("formatted", text).withColumn("loss_spans", spans).drop("__p")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, "</turn>\\n"), lambda x: x != "")

    def turn(x):
        header = F.substring_index(x, "\n", 1)
        role = header.substr(F.lit(len(HEAD) + 1), F.length(header) - len(HEAD) - 1)
        text = x.substr(F.length(header) + 2, F.length(x))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One record (the rows layout) per conversation from one row per turn."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.coalesce(x["turn"], F.lit(0)).alias("turn")))
    return rows.groupBy(id_col).agg(turns.alias("turns"))


def canonical_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per record of a table: its fingerprint, layout and turns, by the table's schema."""
    body = records.drop(id_col)
    mark = fingerprint(schema_shape(body.schema))
    known = {fingerprint(of_shape): (name, rule) for name, (of_shape, rule) in MAPPINGS.items()}
    if mark not in known:
        raise ValueError(f"no mapping for records of the layout {schema_shape(body.schema)}")
    layout, rule = known[mark]
    return records.select(id_col, F.lit(mark).alias("fingerprint"), F.lit(layout).alias("layout"), _filled(F.expr(rule)).alias("turns"))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", *others: DataFrame) -> DataFrame:
    """One row per conversation: its layout, canonical turns, formatted text and loss spans.

    ``rows`` has one row per turn; others hold one record per row, each table in a layout of its own.
    """
    turns = canonical_turns(conversation_turns(rows, id_col), id_col)
    for table in others:
        turns = turns.unionByName(canonical_turns(table, id_col))
    return format_turns(turns)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What reading the formatted texts back gives."""
    back = formatted.withColumn("__back", read_back(F.col("formatted"))).withColumn("__loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("__back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("__back").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
