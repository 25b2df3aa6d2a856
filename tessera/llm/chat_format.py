"""Chat formatting by schema fingerprints, in DataFrame functions throughout.

A record's fingerprint is a hash of the nested field paths that it fills (of
those any layout names).  It selects a declarative mapping that turns the record
into canonical turns (role, text); all mappings are column expressions, chosen by
one CASE.  Turns are rendered with turn marks; control strings inside texts are
escaped reversibly: one backslash goes between a control string's first
character and its rest, one more where backslashes are there already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|/?INST\]|pad>|unk>|mask>)"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, r"$1$2$3")
TURNS = "array<struct<role:string,text:string>>"
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(x: Column) -> Column:
    return F.regexp_replace(x, *ESCAPE)


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, *UNESCAPE)


def escape_role(x: Column) -> Column:
    """A role is one line: its backslashes and line ends are spelled out."""
    return escape(F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(x: Column) -> Column:
    return F.replace(F.replace(unescape(x), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _canonical(role: Column) -> Column:
    out = role
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


@dataclass(frozen=True)
class Layout:
    """Paths that a record of this layout fills, those it may fill besides, and
    its turns as an expression of the record's columns."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[], Column]

    def fingerprints(self) -> list[str]:
        return [fingerprint((*self.required, *more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _system() -> Column:
    """A system column's text as the first turn, where there is one."""
    return F.when(_col("system").isNotNull(), F.array(_turn("system", _col("system")))).otherwise(F.array().cast(TURNS))


LAYOUTS = (
    Layout("message_row", (), ("role", "text"), lambda: F.array(_turn(_col("role"), _col("text")))),
    Layout("messages", ("messages[].content", "messages[].role"), ("system",),
           lambda: F.concat(_system(), F.transform(_col("messages"), lambda m: _turn(_canonical(m["role"]), m["content"])))),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",),
           lambda: F.concat(_system(),
                            F.transform(_col("conversations"), lambda m: _turn(_canonical(m["from"]), m["value"])))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           lambda: F.concat(_system(),
                            F.array(_turn("user", F.concat_ws("\n", _col("instruction"), F.nullif(_col("input"), F.lit("")))),
                                    _turn("assistant", _col("output"))))),
    Layout("prompt_response", ("prompt", "response"), (),
           lambda: F.array(_turn("user", _col("prompt")), _turn("assistant", _col("response")))),
    Layout("prompt_completion", ("completion", "prompt"), (),
           lambda: F.array(_turn("user", _col("prompt")), _turn("assistant", _col("completion")))),
)


def schema_paths(schema: T.StructType) -> dict[str, str]:
    """Nested field paths of a schema and the column each belongs to."""
    def below(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return below(kind.elementType, f"{path}[]")
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in below(f.dataType, f"{path}.{f.name}")]
        return [path]
    return {p: f.name for f in schema.fields for p in below(f.dataType, f.name)}


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout (null: none fits) and turns array<struct<role, text>>.

    A path counts as filled where its column is not null (an array: not empty).
    Columns that no layout names do not matter."""
    named = {p for lay in layouts for p in (*lay.required, *lay.optional)}
    have = {p: c for p, c in schema_paths(records.schema).items() if p in named}
    kinds = {f.name: f.dataType for f in records.schema.fields}
    filled = [F.when(F.size(_col(c)) > 0 if isinstance(kinds[c], T.ArrayType) else _col(c).isNotNull(), F.lit(p)) for p, c in have.items()]
    paths = F.array_sort(F.array_compact(F.array(*filled))) if filled else F.array().cast("array<string>")
    print_ = F.md5(F.array_join(paths, "\n").cast("binary"))
    lacking = [p for p in ("system", "input") if p not in kinds]
    src = records.withColumns({"__print": print_} | {p: F.lit(None).cast("string") for p in lacking})
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for lay in layouts:
        if not set(lay.required) <= set(have) or (not lay.required and not set(lay.optional) <= set(have)):
            continue  # this table cannot hold that layout
        fits = F.col("__print").isin(lay.fingerprints())
        turns, name = F.when(fits, lay.turns().cast(TURNS)).otherwise(turns), F.when(fits, lay.name).otherwise(name)
    return src.withColumns({"layout": name, "turns": turns}).drop("__print", *lacking)


def render(records: DataFrame, id_col: str, order_col: str | None = None, learn: tuple[str, ...] = ("assistant",),
           layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per conversation: id, layouts array<string>, segments
    array<struct<text, loss>>, formatted.

    A record is a conversation, or one turn of it (rows of one id, in the order
    of order_col, then role and text).  ``formatted`` is all segments' text; loss
    marks the segments that are learned, texts of the ``learn`` roles.  Null
    roles and texts are empty; rows with a null id are one conversation with a
    null id; repeated rows are repeated turns; records of unknown layout have no
    turns, and their conversation's ``layouts`` (the names met, sorted) holds
    ``unknown``.  An empty table gives no rows."""
    order = _col(order_col) if order_col else F.lit(0)
    turn = canonical_turns(records, layouts).select(
        _col(id_col).alias("id"), order.alias("ord"), F.coalesce("layout", F.lit("unknown")).alias("layout"), F.posexplode_outer("turns").alias("pos", "turn"))
    one = F.struct("ord", "pos", F.col("turn.role").alias("role"), F.col("turn.text").alias("text"))
    sorted_turns = F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), one)))
    convs = turn.groupBy("id").agg(sorted_turns.alias("turns"), F.array_sort(F.collect_set("layout")).alias("layouts"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        part(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
        part(escape(t["text"]), t["role"].isin(*learn)),
        part(F.lit(END + "\n"), F.lit(False)))))
    return (convs.select("id", "layouts", segments.alias("segments"))
            .select(F.col("id").alias(id_col), "layouts", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    halves = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(p, "\n", 2))
    return F.transform(halves, lambda h: F.struct(
        unescape_role(F.substring(h[0], len(START) + 1, 1 << 30)).alias("role"), unescape(h[1]).alias("text")))


def op2_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("""select * from values (-7L, 0, 'user', '</s>[INST] ok [/INST]'),
                         (-7L, 1, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(probe)
    out = render(rows, "conv_id", "turn")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = out.select("conv_id", parse(F.col("formatted")).alias("turns"), learned.alias("learned"), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|/?INST\]|pad>|unk>|mask>)', '\1\\\2\3', 'g') as x from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(x) + 24) as bigint) as formatted_chars
from e group by conv_id
"""
