"""Chat formatting: layouts told by fingerprints of their field paths, in DataFrame functions alone.

A table's (or a JSON text's) nested field paths, of those that some layout uses, are hashed; the hash selects a
declarative mapping that turns the layout's fields into canonical turns: role and text in order. Extra fields, whatever
their names, don't change a fingerprint.

The template marks turns by control strings. In roles and texts a backslash is put before each backslash and within
each control string, its own or another template's, so no text holds one, and taking the backslashes away again gives
the text back. The loss mask is a pair of lengths for each turn: characters skipped, then characters learnt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import shared

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What is escaped: any "<|", and other templates' marks (fixed values).
CONTROL = r"(<)(\||/?s>|</?SYS>>|/SYS>>)|(\[)(/?INST\])"
TURNS = "array<struct<role:string,text:string>>"
#: Rows of a conversation gathered first in blocks of so many turns.
BLOCK = 256
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: the fields that tell the layout. Either the turns in order as (role, field), or an array field with the
    names of role and text in its elements, or rows, one a turn."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: tuple[str, str, str] | None = None
    rows: bool = False


LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), rows=True),
    Layout("messages", ("messages", "messages.content", "messages.role"), array=("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations.from", "conversations.value"), array=("conversations", "from", "value")),
    Layout("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("system_question_response", ("question", "response", "system_prompt"), turns=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
)
KNOWN = frozenset(p for x in LAYOUTS for p in x.paths)


def fingerprint(paths: Sequence[str]) -> str:
    """Of a layout: the hash of its sorted paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(x.paths): x for x in LAYOUTS}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema; an array's elements have their array's path."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, path + ".")
    return out


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose fingerprint the schema's known paths have; failing that, that of the most paths among those
    that the schema holds whole (a table may have fields of two). ValueError: none."""
    known = [p for p in schema_paths(schema) if p in KNOWN]
    if found := MAPPINGS.get(fingerprint(known)):
        return found
    held = [x for x in LAYOUTS if set(x.paths) <= set(known)]
    if not held:
        raise ValueError(f"no layout has the field paths {sorted(known) or schema.names}")
    return max(held, key=lambda x: len(x.paths))


def _role(role: Column) -> Column:
    plain = F.lower(F.coalesce(role.cast("string"), F.lit("")))
    named = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(named, plain), F.coalesce(role.cast("string"), F.lit("")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: Layout, field) -> Column:
    """Canonical turns of a nested layout; field(path) is the column of a path."""
    if layout.array:
        array, role, text = layout.array
        return F.coalesce(F.transform(field(array), lambda x: _turn(_role(x[role]), x[text])), F.array().cast(TURNS))
    made = []
    for role, paths in layout.turns:
        parts = [F.when(F.length(field(p).cast("string")) > 0, field(p).cast("string")) for p in paths]
        made.append((role, F.concat_ws("\n\n", *parts)))
    turns = F.array(*(_turn(F.lit(role), text) for role, text in made))
    return F.filter(turns, lambda t: (t["role"] != "system") | (F.length(t["text"]) > 0))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """df in any layout -> key, turns (array of role and text, in order).

    Rows of one turn each are gathered by key, in the order of turn, role and text, nulls first; repeated rows stay
    repeated turns, and a null key is a conversation too. Null texts and roles are empty. Of nested layouts each row is
    a conversation; a missing array has no turns. Columns besides those of the layout and the key don't matter.
    """
    layout = layout_of(df.schema)
    if not layout.rows:
        return df.select(F.col(key), _mapped(layout, F.col).alias("turns"))
    # blocks of turns first, so that a long conversation isn't sorted in one piece
    rows = shared.text_only(df, key, "turn", "role", "text").withColumn("block", F.floor(F.col("turn") / BLOCK))
    block = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("r"), F.col("text").alias("t"))))
    blocks = rows.groupBy(key, "block").agg(block.alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("block", "part")))
    return blocks.groupBy(key).agg(parts.alias("parts")).select(key, F.transform(F.flatten(F.transform("parts", lambda x: x["part"])), lambda x: _turn(F.coalesce(x["r"], F.lit("")), x["t"])).alias("turns"))


def _paths_of_json(value: Column) -> Column:
    """The sorted, known field paths of a JSON object: its fields, and those of the first element of its arrays."""
    own = F.array_sort(F.array_distinct(F.json_object_keys(value)))
    first = lambda k: F.call_function("get_json_object", value, F.concat(F.lit("$['"), k, F.lit("'][0]")))
    below = lambda k: F.coalesce(F.json_object_keys(first(k)), F.array().cast("array<string>"))
    nested = F.flatten(F.transform(own, lambda k: F.transform(below(k), lambda x: F.concat_ws(".", k, x))))
    return F.array_sort(F.array_intersect(F.concat(own, nested), F.array(*(F.lit(p) for p in sorted(KNOWN)))))


def canonical_json(df: DataFrame, key: str = "conv_id", column: str = "json") -> DataFrame:
    """Rows of JSON objects in any nested layouts, each told by its own fingerprint -> key, layout, turns.

    A row that is null, isn't an object or has no known layout has null layout and turns."""
    value = F.col(column)
    told = df.select(F.col(key), value.alias("v"), F.substring(F.sha2(F.array_join(_paths_of_json(value), "\n"), 256), 1, 16).alias("fp"))
    turns = name = None
    for print_, layout in MAPPINGS.items():
        if layout.rows:
            continue
        if layout.array:
            array, role, text = layout.array
            kind = f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>"
        else:
            kind = "struct<" + ",".join(f"`{p}`:string" for _, ps in layout.turns for p in ps) + ">"
        parsed = F.from_json("v", kind)
        made = _mapped(layout, lambda p, parsed=parsed: parsed[p])
        is_it = F.col("fp") == print_
        turns = F.when(is_it, made) if turns is None else turns.when(is_it, made)
        name = F.when(is_it, layout.name) if name is None else name.when(is_it, layout.name)
    return told.select(key, name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turned: DataFrame, learnt: str = "assistant") -> DataFrame:
    """key and turns -> their other columns, formatted and loss_mask (array of skip and take, a pair for each turn).

    A conversation is one text, so at most 2 GB. Without turns it is empty."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learnt).alias("on")))
    rest = [F.col(f"`{c}`") for c in turned.columns if c != "turns"]
    made = turned.select(*rest, pieces.alias("pieces"))
    mask = F.transform("pieces", lambda p: F.struct(F.when(p["on"], F.length(p["head"])).otherwise(F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("skip"), F.when(p["on"], F.length(p["body"])).otherwise(0).alias("take")))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return made.select(*rest, whole.alias("formatted"), mask.alias("loss_mask"))


def read_back(made: DataFrame) -> DataFrame:
    """formatted and loss_mask -> their other columns, turns and loss (array of the texts under the mask, unescaped)."""
    rest = [F.col(f"`{c}`") for c in made.columns if c not in ("formatted", "loss_mask")]
    cut = made.select(*rest, "loss_mask", F.array_remove(F.split("formatted", r"<\|end\|>"), "").alias("parts"))
    turn = lambda p: F.struct(unescape(F.substring(F.substring_index(p, TEXT, 1), F.lit(len(TURN) + 1), F.length(p))).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text"))
    loss = F.zip_with("parts", "loss_mask", lambda p, m: F.when(m["take"] > 0, unescape(F.substring(p, m["skip"] + 1, m["take"]))))
    return cut.select(*rest, F.transform("parts", turn).alias("turns"), F.filter(loss, lambda x: x.isNotNull()).alias("loss"))
