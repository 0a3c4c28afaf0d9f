r"""Chat formatting by schema fingerprints (operator 4).

The nested field paths of a table (or of each JSON record) are hashed; the hash selects a declarative mapping that
turns the layout into canonical turns (role, text), one row a turn. A mapping's fingerprint covers the paths that it names, so
fields beside them don't matter; of several that fit, the one that names most fields is taken, of equals the first by
name. Turns are rendered as

    <s>[role]\n text </s>\n

with every control string inside a text escaped: ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``[role]`` and the escape itself
all begin with ``<``, ``[`` or the escape character, and each such character is preceded by ``\``, which is reversible and
leaves no control string. The loss mask covers the texts of assistants.

Rows of a conversation are streamed in order through one task's reader, which keeps a digest, not the text; the
order comes from a shuffle by conversation and a sort that spills. ``segments`` has one row per turn.

Defined cases: a table that no mapping fits is an error, a JSON record that none fits has null turns; an empty list of messages
is a conversation without turns (null lists likewise) and has no row among rows of turns; messages without a text have an empty one; null
messages in a list are left out. Where the input has columns
named like the new ones (``layout``, ``turns``), the new ones get a ``_`` at their end. Null text and null role are empty; turns sort by turn (null first), then role and text, so ties and repeated
rows give one result; null conv_id is a conversation of its own; an empty table has only conversation -1. Columns other
than those named are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common

RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURNS = "array<struct<role:string,text:string>>"
_SPECIAL = ("\\", "<", "[")
_ESCAPE = str.maketrans({c: "\\" + c for c in _SPECIAL})


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = f"<s>[{escape(role).replace(']', chr(92) + ']')}]\n"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


class Reader:
    """Reads formatted text back, fed in pieces of any size; calls ``turn(role, text)`` for every turn."""

    def __init__(self, turn: Callable[[str, str], None]):
        self.turn, self.rest = turn, ""

    def feed(self, piece: str) -> None:
        self.rest += piece
        while self._one():
            pass

    def _find(self, mark: str, at: int) -> int:
        """The first ``mark`` from ``at`` that isn't escaped."""
        i = at - 1
        while (i := self.rest.find(mark, i + 1)) >= 0:
            j = i
            while j > at and self.rest[j - 1] == "\\":
                j -= 1
            if (i - j) % 2 == 0:
                return i
        return -1

    def _one(self) -> bool:
        if not self.rest.startswith("<s>["):
            if self.rest and not "<s>[".startswith(self.rest[:4]):
                raise ValueError("no turn where one should begin")
            return False
        head = self._find("]\n", 4)
        if head < 0:
            return False
        end = self._find("</s>\n", head + 2)
        if end < 0:
            return False
        role, text = self.rest[4:head], self.rest[head + 2 : end]
        self.rest = self.rest[end + 5 :]
        self.turn(unescape(role), unescape(text))
        return True

    def close(self) -> None:
        if self.rest:
            raise ValueError("the last turn doesn't end")


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out += [text[i:j], text[j + 1 : j + 2]]
        i = j + 2
    return "".join([*out, text[i:]])


# Layouts


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; an array adds ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, at + "[]")
    return [at]


def json_paths(x, at: str = "") -> set[str]:
    """The same of a JSON value; an empty list has the path of its array."""
    if isinstance(x, dict):
        return set().union(*[json_paths(v, f"{at}.{k}" if at else k) for k, v in x.items()])
    if isinstance(x, list):
        return set().union(*[json_paths(v, at + "[]") for v in x if v is not None]) or {at + "[]"}
    return {at}


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A mapping: ``fields`` gives a record's turns as (role, path) in order, paths joined by + meaning both texts; ``array``
    names a list of messages with their role and text fields; ``row`` the turn, role and text columns of a table of turns."""

    fields: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None

    @property
    def paths(self) -> frozenset[str]:
        if self.array:
            name, role, text = self.array
            return frozenset((f"{name}[].{role}", f"{name}[].{text}"))
        return frozenset(self.row or [p for _, x in self.fields for p in x.split("+")])


LAYOUTS: dict[str, Layout] = {
    "turn-rows": Layout(row=("turn", "role", "text")),
    "turn-rows-content": Layout(row=("turn", "role", "content")),
    "turn-rows-from": Layout(row=("index", "from", "value")),
    "prompt": Layout((("user", "prompt"), ("assistant", "completion"))),
    "prompt-response": Layout((("user", "prompt"), ("assistant", "response"))),
    "system-prompt": Layout((("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "instruction": Layout((("user", "instruction"), ("assistant", "output"))),
    "instruction-input": Layout((("user", "instruction+input"), ("assistant", "output"))),
    "messages": Layout(array=("messages", "role", "content")),
    "conversations": Layout(array=("conversations", "from", "value")),
    "question": Layout((("user", "question"), ("assistant", "answer"))),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Which paths to hash, and what the hash selects; those of most paths first.
BY_PRINT: list[tuple[frozenset[str], str, str]] = sorted(((x.paths, fingerprint(x.paths), n) for n, x in LAYOUTS.items()), key=lambda x: (-len(x[0]), x[2]))


def layout_of(found) -> str | None:
    """The layout whose fingerprint the paths have, those that it doesn't name left aside; None if none has."""
    found = set(found)
    for named, print_, name in BY_PRINT:
        if fingerprint(found & named) == print_:
            return name
    return next((n for n, x in LAYOUTS.items() if x.array and found & {f"{x.array[0]}[]", f"{x.array[0]}[].{x.array[1]}"}), None)


def _role(c: Column) -> Column:
    """A role's canonical name; null is empty."""
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(named[c], c, F.lit(""))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _at(c: str) -> Column:
    return F.col(f"`{c}`")


def _joined(path: str) -> Column:
    parts = path.split("+")
    return _text(_at(path)) if len(parts) == 1 else F.concat_ws("\n", *[F.nullif(_at(c).cast("string"), F.lit("")) for c in parts])


def _layout(df: DataFrame, keep: list[str]) -> Layout:
    found = paths(T.StructType([f for f in df.schema.fields if f.name not in keep]))
    name = layout_of(found)
    if name is None:
        raise ValueError(f"no layout has the fields {sorted(found)}")
    return LAYOUTS[name]


def canonical(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``turns`` of a typed table of records; its schema without ``keep`` selects the mapping."""
    x = _layout(df, keep)
    turn = lambda role, c: F.struct(role.alias("role"), c.alias("text"))
    if x.row:
        raise ValueError("a table of turns has no records; see turn_rows()")
    if x.array:
        array, role, text = x.array
        messages = F.filter(F.coalesce(_at(array), F.array().cast(df.schema[array].dataType)), lambda m: m.isNotNull())
        turns = F.transform(messages, lambda m: turn(_role(m[role].cast("string")), _text(m[text])))
    else:
        turns = F.array(*[turn(F.lit(r), _joined(p)) for r, p in x.fields])
    return df.select(*map(_at, keep), turns.alias(common.fresh(df.select(*map(_at, keep)), "turns")))


def turn_rows(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a typed table, whatever its layout: one row a turn. The fingerprint of its schema selects the mapping."""
    x = _layout(df, [conv])
    if x.row:
        turn, role, text = map(_at, x.row)
        role = _text(role) if x.row[1] == "role" else _role(role.cast("string"))  # roles so named are canonical as they stand
        return df.select(_at(conv).cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), _text(text).alias("text"))
    made = canonical(df, [conv]).select(_at(conv).cast("long").alias("conv_id"), F.posexplode("turns").alias("turn", "t"))
    return made.select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def _one(raw: str | None) -> tuple[str | None, list[dict] | None]:
    """Layout and turns of a JSON record."""
    try:
        x = json.loads(raw)
        name = layout_of(json_paths(x)) if isinstance(x, dict) else None
    except (TypeError, ValueError, RecursionError):
        return None, None
    if name is None:
        return None, None
    rule, s = LAYOUTS[name], lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
    if rule.array:
        array, role, text = rule.array
        return name, [{"role": ROLES.get(s(m.get(role)), s(m.get(role))), "text": s(m.get(text))} for m in x[array] if isinstance(m, dict)]
    if rule.row:  # a record that is a turn itself
        _, role, text = rule.row
        return name, [{"role": s(x[role]) if role == "role" else ROLES.get(s(x[role]), s(x[role])), "text": s(x[text])}]
    return name, [{"role": r, "text": "\n".join(t for c in p.split("+") if (t := s(x[c])) or "+" not in p)} for r, p in rule.fields]


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """df with ``layout`` and ``turns`` of each JSON record in ``column``; both null where no layout fits or it isn't JSON."""
    new = [common.fresh(df, "layout"), common.fresh(df, "turns")]
    schema = T.StructType([*df.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T._parse_datatype_string(TURNS))])
    place, names = df.columns.index(column), schema.names

    def run(batches):
        for b in batches:
            made = [_one(r) for r in b.column(place).to_pylist()]
            turns = pa.array([t for _, t in made], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for n, _ in made], pa.string()), turns], names)

    return df.mapInArrow(run, schema)


# Formatting


def format_turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """A turn as text and where its own text begins and ends in it, as Spark expressions: render() without Python."""
    esc = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([\\<\[])", r"\\$1")
    head = F.concat(F.lit("<s>["), F.regexp_replace(esc(role), r"\]", r"\\]"), F.lit("]\n"))
    body = esc(text)
    return F.concat(head, body, F.lit("</s>\n")), F.char_length(head).cast("long"), (F.char_length(head) + F.char_length(body)).cast("long")


def segments(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with ``segment``, ``loss`` (assistants), ``begin`` and ``end`` of the text in it."""
    segment, begin, end = format_turn(F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "text", segment.alias("segment"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"), begin.alias("begin"), end.alias("end"))


def _read_back(batches) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its formatted segments in order; keeps one conversation's digests."""
    state: dict = {}
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    out: list[tuple] = []

    def begin(conv):
        state.clear()
        state.update(conv=conv, n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), chars=0, size=0)
        state["reader"] = Reader(turn)

    def turn(role, text):
        state["n"] += 1
        state["turns"].update(f"{role}\n{text}\n".encode())

    def end():
        state["reader"].close()
        out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

    def flush():
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)
        out.clear()
        return batch

    for b in batches:
        for conv, segment, loss, x, y in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if not state or state["conv"] != conv:
                if state:
                    end()
                begin(conv)
            state["size"] += len(segment)
            state["reader"].feed(segment)
            if loss:
                masked = unescape(segment[x:y])
                state["chars"] += len(masked)
                state["loss"].update(masked.encode())
        if len(out) > 5000:
            yield flush()
    if state:
        end()
    yield flush()


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): what is read back from its formatted text."""
    common.prepare(rows.sparkSession)
    s = segments(rows.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string")))
    ordered = s.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "loss", "begin", "end").mapInArrow(_read_back, RESULT)


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, text, loss_spans): whole conversations as one text each, with the assistants' spans in code points."""
    s = segments(rows)
    g = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment", "loss", "begin", "end"))).alias("t"))
    before = lambda i: F.aggregate(F.slice("t", 1, i), F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x["segment"]))
    spans = F.filter(F.transform("t", lambda x, i: F.struct((before(i) + x["begin"]).alias("begin"), (before(i) + x["end"]).alias("end"), x["loss"].alias("loss"))), lambda x: x["loss"])
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), F.transform(spans, lambda x: F.struct(x["begin"], x["end"])).alias("loss_spans"))


PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) and conversation -1, whose texts look like control strings."""
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe)
