"""Chat formatting, with DataFrame functions alone.

1. Each row's layout is fingerprinted: the nested field paths that hold something, out of those that any known layout
   uses, are joined and hashed. Columns that no layout knows don't count.
2. The fingerprint selects a declarative mapping (LAYOUTS) that lists the row's turns as (turn, role, text).
3. Turns are put in order within their conversation and rendered by a template; control strings inside texts are
   escaped reversibly, and each piece of the output says whether it is under the loss mask.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TURN = "struct<turn:bigint,role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """paths: the field paths that such a row holds, array elements as []; optional: paths that may be missing.

    A layout of rows applies to tables that have its turn column, whatever a row of them holds.
    turns: for a flat layout the (role, column) pairs in order; for a list layout ("list column", role field, text field).
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    flat: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None


#: Declarative mappings; a row that fits none yields no turns (see to_turns).
LAYOUTS = (
    Layout("turn rows", (), ("turn", "role", "text"), row=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].role"), ("messages[].content",), listed=("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from"), ("conversations[].value",), listed=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Layout("prompt response", ("prompt", "response"), ("system",), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt completion", ("prompt", "completion"), ("system",), flat=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question answer", ("question", "answer"), ("context",), flat=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
)
#: Role names that other layouts use for the canonical ones.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


def _known_paths() -> list[str]:
    return sorted({p for x in LAYOUTS for p in (*x.paths, *x.optional)})


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _variants(layout: Layout) -> list[str]:
    """Fingerprints of the layout with each choice of its optional paths."""
    picks = [[]]
    for p in layout.optional:
        picks += [[*x, p] for x in picks]
    return [fingerprint_of([*layout.paths, *x]) for x in picks]


def _field(schema: T.StructType, name: str) -> T.DataType | None:
    return schema[name].dataType if name in schema.names else None


def _presence(schema: T.StructType, path: str) -> Column | None:
    """Whether a row holds something at path; None where the schema has no such path or another kind of column."""
    column, _, inner = path.partition("[].")
    kind = _field(schema, column)
    if inner:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and inner in kind.elementType.names:
            return F.coalesce(F.exists(F.col(f"`{column}`"), lambda e: e[inner].isNotNull()), F.lit(False))
        return None
    if kind is None or (any(p.startswith(f"{path}[]") for p in _known_paths()) != isinstance(kind, T.ArrayType)):
        return None
    return F.col(f"`{column}`").isNotNull()


def schema_fingerprint(df: DataFrame) -> Column:
    """The hash of the known nested field paths that a row holds, in order of their names, one to a line."""
    held = [F.when(c, F.lit(p)) for p in _known_paths() if (c := _presence(df.schema, p)) is not None]
    return F.sha2(F.concat_ws("\n", *held) if held else F.lit(""), 256)


def _role(c: Column) -> Column:
    named = F.lower(F.trim(c))
    out = F.coalesce(c, F.lit(""))
    for other, canonical in ROLE_NAMES.items():
        out = F.when(named == other, F.lit(canonical)).otherwise(out)
    return out


def _turns(df: DataFrame, layout: Layout) -> Column | None:
    """array<struct<turn,role,text>> by the layout; None if the schema can't hold it."""
    if any(_presence(df.schema, p) is None for p in (*layout.paths, *(layout.row or ())[:1])):
        return None
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")
    if layout.row:
        turn, role, body = layout.row
        return F.array(F.struct(F.col(f"`{turn}`").cast("bigint").alias("turn"), _role(text(role)).alias("role"), text(body).alias("text")))
    if layout.listed:
        column, role, body = layout.listed
        fields = df.schema[column].dataType.elementType.names
        return F.transform(
            F.col(f"`{column}`"),
            lambda e, i: F.struct(
                i.cast("bigint").alias("turn"),
                _role(F.coalesce(e[role].cast("string"), F.lit(""))).alias("role"),
                (F.coalesce(e[body].cast("string"), F.lit("")) if body in fields else F.lit("")).alias("text"),
            ),
        )
    parts, flat = [], dict(layout.flat)
    for i, (role, column) in enumerate(layout.flat):
        if role == "user+" or column not in df.columns:
            continue
        body = F.col(f"`{column}`").cast("string")
        if role == "user" and "user+" in flat and flat["user+"] in df.columns:
            body = F.concat_ws("\n\n", body, F.nullif(F.col(f"`{flat['user+']}`").cast("string"), F.lit("")))
        turn = F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.coalesce(body, F.lit("")).alias("text"))
        parts.append(F.when(F.col(f"`{column}`").isNotNull(), turn))
    return F.filter(F.array(*parts), lambda t: t.isNotNull())


def to_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of rows in any of the known layouts.

    Null roles and texts are empty, a null turn stays null (and comes first, see format_chats); a row that fits no layout gives no
    turn, and unmatched(df) returns such rows. Extra columns are left aside; layouts may differ from row to row. Repeated rows are
    turns each. Empty table: no rows.
    """
    picked = F.lit(None).cast(f"array<{_TURN}>")
    for layout in LAYOUTS:
        if (turns := _turns(df, layout)) is not None:
            picked = F.when(F.col("_fp").isin(_variants(layout)), turns.cast(f"array<{_TURN}>")).otherwise(picked)
    turns = df.withColumn("_fp", schema_fingerprint(df)).select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.inline(picked))
    return turns


def unmatched(df: DataFrame) -> DataFrame:
    """The rows whose fingerprint no layout has."""
    known = [f for x in LAYOUTS if _turns(df, x) is not None for f in _variants(x)]
    return df.where(~schema_fingerprint(df).isin(known))


#: The template's control strings, as a pattern of what follows each one's first character.
_CONTROL_REST = r"(?:/?s>|/?INST\]|/?ROLE\])"
START, END, USER, USER_END, ROLE, ROLE_END = "<s>", "</s>", "[INST] ", " [/INST]", "[ROLE]", "[/ROLE]"


def escape(c: Column) -> Column:
    """Put one backslash (after any that are there) behind the first character of what reads as a control string."""
    return F.regexp_replace(c, rf"([<\[])(\\*)(?={_CONTROL_REST})", r"$1$2\\")


def unescape(c: Column) -> Column:
    """Undo escape exactly."""
    return F.regexp_replace(c, rf"([<\[])(\\*)\\(?={_CONTROL_REST})", "$1$2")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>.

    formatted is all segments joined; a segment with loss = true is an assistant's text. Turns are ordered by turn, role
    and text, nulls first; repeated rows are turns each. A conversation's output is one string, so one conversation has to
    fit into a task, as any row does; a null conv_id is a conversation of its own. No turns: no rows.
    """
    body = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    piece = (
        F.when(role == "user", F.array(*_segments((F.concat(F.lit(START + USER), body, F.lit(USER_END + END)), False))))
        .when(role == "assistant", F.array(*_segments((F.lit(START), False), (body, True), (F.lit(END), False))))
        .otherwise(F.array(*_segments((F.concat(F.lit(START + ROLE), escape(role), F.lit(ROLE_END), body, F.lit(END)), False))))
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), piece.alias("piece"))))
    listed = turns.groupBy("conv_id").agg(ordered.alias("t"))
    segments = F.flatten(F.transform("t", lambda t: t["piece"]))
    return listed.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _segments(*parts: tuple[Column, bool]) -> list[Column]:
    return [F.struct(c.alias("text"), F.lit(loss).alias("loss")) for c, loss in parts]


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(START) + 1))
        is_user = rest.startswith(USER)
        is_other = rest.startswith(ROLE)
        cut = F.instr(rest, ROLE_END)
        user_text = F.substr(rest, F.lit(len(USER) + 1), F.char_length(rest) - F.lit(len(USER) + len(USER_END)))
        return F.struct(
            F.when(is_user, F.lit("user")).when(is_other, unescape(F.substr(rest, F.lit(len(ROLE) + 1), cut - F.lit(len(ROLE) + 1)))).otherwise(F.lit("assistant")).alias("role"),
            unescape(F.when(is_user, user_text).when(is_other, F.substr(rest, cut + F.lit(len(ROLE_END)))).otherwise(rest)).alias("text"),
        )

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats: counts and digests of turns and of what is under the loss mask."""
    read = formatted.select("conv_id", "formatted", "segments", parse_chat(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
