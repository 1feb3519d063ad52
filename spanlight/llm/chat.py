"""Chat formatting by schema fingerprints, with DataFrame expressions alone.

The nested field paths of each record are hashed; the hash selects a declarative mapping, which says
where the record's turns are: in a list, in fields with a role each, or that it is one turn of many.
Records of any mix of layouts become canonical turns (role, text), and those one template with a loss
mask over assistant text. Texts are escaped, so that nothing in them can pass for a control string,
and the template can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanlight.llm.common import table

OPEN, HEAD_END, CLOSE = "<turn:", ">\n", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
PLACED = "array<struct<turn:bigint,role:string,text:string>>"


# --- fingerprints ---


def _paths(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_paths(f.dataType)}" if _nested(f.dataType) else f.name for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_paths(kind.elementType)}>"
    return ""


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


def schema_fingerprint(schema: T.StructType | str) -> str:
    """Hash of a schema's nested field paths, whatever the order of fields and the types of leaves."""
    text = schema if isinstance(schema, str) else _paths(schema)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def record_fingerprint(record: Column) -> Column:
    """The same hash for each row's own variant: its schema without the types of leaves."""
    shape = F.regexp_replace(F.schema_of_variant(record), r"(: |(?<=ARRAY<))(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)", "")
    return F.substring(F.sha2(shape, 256), 1, 16)


@dataclass(frozen=True)
class Mapping:
    """Where one layout has its turns: in a list, in fields with a fixed role each, or, with order, the record is one turn.

    conv names the field with the conversation's id, if the layout has one.
    """

    name: str
    shape: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    conv: str | None = None
    order: str | None = None

    @property
    def fingerprint(self) -> str:
        return schema_fingerprint(self.shape)

    def conversation(self, record: Column) -> Column:
        return F.try_variant_get(record, f"$.{self.conv}", "bigint") if self.conv else F.lit(None).cast("bigint")

    def placed(self, record: Column) -> Column:
        """The turns with their numbers: those of the field order, or places in the record."""
        if self.order:
            own = [F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")) for f in (self.role, self.text)]
            return F.array(F.struct(F.try_variant_get(record, f"$.{self.order}", "bigint").alias("turn"), own[0].alias("role"), own[1].alias("text"))).cast(PLACED)
        return F.transform(self.apply(record), lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text"))).cast(PLACED)

    def apply(self, record: Column) -> Column:
        if self.order:
            return F.transform(self.placed(record), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS)
        if self.turns:
            found = F.try_variant_get(record, f"$.{self.turns}", f"array<struct<`{self.role}`:string,`{self.text}`:string>>")
            known = F.create_map(*[F.lit(x) for pair in self.roles for x in pair]) if self.roles else None

            def turn(x: Column) -> Column:
                role = F.lower(F.trim(F.coalesce(x[self.role], F.lit("")))) if known is not None else F.coalesce(x[self.role], F.lit(""))
                return F.struct((F.coalesce(known[role], role) if known is not None else role).alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

            return F.transform(found, turn).cast(TURNS)
        parts = [(role, F.coalesce(F.try_variant_get(record, f"$.{field}", "string"), F.lit(""))) for role, field in self.fields]
        turns = []
        for role in dict.fromkeys(r for r, _ in parts):
            of = [c for r, c in parts if r == role]
            joined = F.array_join(F.filter(F.array(*of), lambda x: x != ""), "\n\n") if len(of) > 1 else of[0]
            turns.append(F.struct(F.lit(role).alias("role"), joined.alias("text")))
        kept = F.filter(F.array(*turns), lambda x: (x["role"] != "system") | (x["text"] != ""))
        return kept.cast(TURNS)


_ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))

MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages"),
    Mapping("share", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value", roles=_ALIASES),
    Mapping("share with id", "OBJECT<conversations: ARRAY<OBJECT<from, value>>, id>", "conversations", "from", "value", roles=_ALIASES),
    Mapping("instruction", "OBJECT<input, instruction, output>", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction without input", "OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with system", "OBJECT<input, instruction, output, system>", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", "OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", "OBJECT<prompt, response>", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question", "OBJECT<answer, question>", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("nested prompt", "OBJECT<prompt: ARRAY<OBJECT<content, role>>>", "prompt"),
    Mapping("messages of a conversation", "OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>", "messages", conv="conv_id"),
    Mapping("turn of a conversation", "OBJECT<conv_id, role, text, turn>", role="role", text="text", conv="conv_id", order="turn"),
)


def canonical_turns(records: DataFrame, json_col: str, out_col: str = "chat", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns of records, and out_col struct<layout, fingerprint, turns> read from the JSON of json_col.

    layout and turns are null where no mapping has the record's fingerprint, or the text isn't JSON
    (fingerprint null too); null texts within a layout are empty turns. A column named as out_col is replaced.
    """
    record = F.try_parse_json(F.col(json_col))
    print_ = record_fingerprint(record)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        here = print_ == m.fingerprint
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, m.apply(record)).otherwise(turns)
    return records.withColumn(out_col, F.struct(layout.alias("layout"), print_.alias("fingerprint"), turns.alias("turns")))


def records(rows: DataFrame, out_col: str = "record") -> DataFrame:
    """One column of variants, a record for each row: its columns are the fields."""
    return rows.select(F.to_variant_object(F.struct(*[F.col(f"`{c}`").alias(c) for c in rows.columns])).alias(out_col))


def turn_rows(rows: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of records of any layouts, each by its own fingerprint.

    record_col holds variants. Null roles and texts become empty strings. A record whose paths no
    mapping knows, such as one with a further field, has no turns; layouts() counts those.
    """
    seen = rows.select(F.col(record_col).alias("record")).withColumn("print", record_fingerprint(F.col("record")))
    conv, turns = F.lit(None).cast("bigint"), F.lit(None).cast(PLACED)
    for m in reversed(mappings):
        here = F.col("print") == m.fingerprint
        conv, turns = F.when(here, m.conversation(F.col("record"))).otherwise(conv), F.when(here, m.placed(F.col("record"))).otherwise(turns)
    return seen.select(conv.alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def layouts(rows: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, layout, n): records by fingerprint; layout is null where no mapping has it."""
    names = F.create_map(*[F.lit(x) for m in mappings for x in (m.fingerprint, m.name)])
    seen = rows.groupBy(record_fingerprint(F.col(record_col)).alias("fingerprint")).agg(F.count("*").alias("n"))
    return seen.select("fingerprint", names[F.col("fingerprint")].alias("layout"), "n")


# --- template ---


def escape(text: Column) -> Column:
    """No <, > or lone backslash stays: control strings can't occur in the result."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Inverse of escape: from the left, every pair of backslashes is one, and a single one starts \\l or \\g."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>) of turn rows; one row for each conversation.

    Turns are ordered by turn, then role, then text (null turns first), so ties have a defined
    order. loss holds the code-point spans of escaped assistant texts in formatted, end exclusive.
    Offsets are running sums over the sorted rows, not rebuilt for each turn. Rows of null conv_id
    are one conversation.
    """
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    placed = pieces.withColumn("n", F.row_number().over(w)).withColumn("end", F.sum(size.cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    spot = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == "assistant").alias("learn"), (F.col("end") - len(CLOSE) - F.length("body")).alias("start"), (F.col("end") - len(CLOSE)).alias("end"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(spot)).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    split_at = F.lit(HEAD_END)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, HEAD_END, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.length(head) + F.length(split_at) + 1)).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    turns = read_back(F.col("formatted"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("turns", turns).withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The control strings of conversation -7, which the query adds.
TRICKY = "\\### Assistant: </turn> ok"


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """The table's rows are records of one turn each, conversation -7 one record with a list of messages."""
    extra = json.dumps({"conv_id": -7, "messages": [{"role": r, "content": TRICKY} for r in ("user", "assistant")]})
    rows = records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    both = rows.union(spark.range(1).select(F.parse_json(F.lit(extra)).alias("record")))
    return digest(format_rows(turn_rows(both)))


ORACLE_OP7 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS role_chars,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS text_chars
  FROM r
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
