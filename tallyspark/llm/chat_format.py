"""Chat formatting: schema fingerprints, canonical turns, one reversible template.

A record's nested field paths are hashed to a fingerprint, and the fingerprint
selects a declarative mapping into canonical turns. The template writes a
conversation as a stream of segments in order; it is never held as a whole, and
reading back finds the turns in that stream by the template's own marks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches

OPEN, SHUT, END = "### ", ":\n", "\n</turn>\n"
#: Inside texts and roles these characters get a backslash, so that no control string can stand there.
CONTROL = r"([\\#<:])"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``rows``: a row is a turn; ``list``: an array of turns; ``fields``: columns in order, each with its role."""

    kind: str
    role: str = ""
    text: str = ""
    turns: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


RENAME = (("human", "user"), ("gpt", "assistant"), ("prompter", "user"), ("bot", "assistant"), ("model", "assistant"))
#: Layouts by their field paths; an array's elements are marked [].
PATHS: list[tuple[tuple[str, ...], Mapping]] = [
    (("role", "text"), Mapping("rows", "role", "text")),
    (("messages[].role", "messages[].content"), Mapping("list", "role", "content", "messages", rename=RENAME)),
    (("conversations[].from", "conversations[].value"), Mapping("list", "from", "value", "conversations", rename=RENAME)),
    (("prompt", "completion"), Mapping("fields", fields=(("prompt", "user"), ("completion", "assistant")))),
    (("prompt", "response"), Mapping("fields", fields=(("prompt", "user"), ("response", "assistant")))),
    (("question", "answer"), Mapping("fields", fields=(("question", "user"), ("answer", "assistant")))),
    (("instruction", "output"), Mapping("fields", fields=(("instruction", "user"), ("output", "assistant")))),
    (("instruction", "input", "output"), Mapping("fields", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")))),
    (("system", "prompt", "completion"), Mapping("fields", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")))),
    (("system", "instruction", "input", "output"), Mapping("fields", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")))),
]
LAYOUTS: dict[str, Mapping] = {fingerprint(p): m for p, m in PATHS}
KNOWN_PATHS = {x for p, _ in PATHS for x in p}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value, at: str = "") -> list[str]:
    """Leaf field paths of a decoded JSON value; fields that are null are not there."""
    if isinstance(value, dict):
        return [p for k, v in value.items() if v is not None for p in value_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in value_paths(v, at + "[]")]
    return [at]


def mapping_of(paths) -> Mapping | None:
    """The mapping for these paths, by the fingerprint of those that some layout knows; other fields may be there as well.

    Where known fields stand beside a whole layout, the layout of most fields is taken, of equals the first.
    """
    own = KNOWN_PATHS & set(paths)
    exact = LAYOUTS.get(fingerprint(own))
    if exact is not None:
        return exact
    parts = [p for p, _ in PATHS if own.issuperset(p)]
    return LAYOUTS[fingerprint(max(parts, key=len))] if parts else None


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Columns conv_id, turn, role, text, from typed columns in any known layout.

    A null role or text is an empty string; a field that is null makes no turn.
    Raises ValueError where no mapping fits the schema.
    """
    m = mapping_of(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for the fields {schema_paths(df.schema)}")
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "rows":
        return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), none(F.col(m.role)).alias("role"), none(F.col(m.text)).alias("text"))
    if m.kind == "list":
        each = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(m.turns).alias("turn", "t")).where("t is not null")
        role = none(F.col(f"t.`{m.role}`"))
        for a, b in m.rename:
            role = F.when(role == a, b).otherwise(role)
        return each.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), none(F.col(f"t.`{m.text}`")).alias("text"))
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text")) for f, r in m.fields])
    each = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(items).alias("turn", "t")).where("t.text is not null")
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def canonical_json(df: DataFrame, record: str, conv_id: str = "conv_id") -> DataFrame:
    """Columns conv_id, turn, role, text from JSON records of mixed layouts, each record by its own fingerprint.

    A record that is null, no JSON object, nested too deep to read, of no known
    layout, or with a turn that is no 64-bit integer or a text that is no
    Unicode, gives one row whose turn is -1 and whose role is ``unknown``, with
    the record as its text.
    """
    say = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)

    def read(text: str | None) -> list[tuple[int, str, str]] | None:
        value = json.loads(text or "")
        m = mapping_of(value_paths(value)) if isinstance(value, dict) else None
        if m is None:
            return None
        if m.kind == "rows":
            turn = value.get("turn") or 0
            ok = isinstance(value.get(m.role), str) and isinstance(turn, int) and -(1 << 63) <= turn < 1 << 63
            return [(int(turn), say(value.get(m.role)), say(value.get(m.text)))] if ok else None
        if m.kind == "list":
            names = dict(m.rename)
            return [(i, names.get(say(v.get(m.role)), say(v.get(m.role))), say(v.get(m.text))) for i, v in enumerate(value[m.turns]) if isinstance(v, dict)]
        return [(i, r, say(value[f])) for i, (f, r) in enumerate(m.fields) if value.get(f) is not None]

    def turns(text: str | None) -> list[tuple[int, str, str]]:
        try:
            got = read(text)
            "".join(x for t in got or () for x in t[1:]).encode()
        except (ValueError, RecursionError):
            got = None
        return [(-1, "unknown", text or "")] if got is None else got

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *t) for i, r in zip(f["conv_id"], f["record"], strict=True) for t in turns(r)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])

    kind = df.schema[conv_id].dataType.simpleString()
    return df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record")).mapInPandas(run, f"conv_id {kind}, turn long, role string, text string")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"\\$1")


def format_turns(turns: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """Columns conv_id, turn, seq, part, segment, loss_from, loss_to: a formatted conversation is its segments by (seq, part).

    ``seq`` numbers the turns of a conversation from 1; turns of the same number are ordered by role and text, so that
    ties have one result. A turn longer than ``piece`` code points goes on in further parts, wherever the cut falls. The
    loss mask, in code points of the segment, covers an assistant's escaped text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.concat_ws("\n", "role", "text"))
    role, body = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SHUT))
    mine = F.col("role") == "assistant"
    whole = turns.select("conv_id", "turn", F.row_number().over(order).alias("seq"), F.concat(head, body, F.lit(END)).alias("w"), F.when(mine, F.length(head)).alias("a"), F.when(mine, F.length(head) + F.length(body)).alias("b"))
    parts = F.sequence(F.lit(0), F.floor((F.length("w") - 1) / piece).cast("int"))
    each = whole.select("*", F.explode(parts).alias("part"))
    at = F.col("part") * piece
    inside = (F.col("a") < at + piece) & (F.col("b") > at)
    return each.select(
        "conv_id", "turn", "seq", "part", F.substring(F.col("w"), at + 1, F.lit(piece)).alias("segment"),
        F.when(inside, F.greatest(F.col("a") - at, F.lit(0))).alias("loss_from"), F.when(inside, F.least(F.col("b") - at, F.lit(piece))).alias("loss_to"),
    )


PLAIN = re.compile(r"(?:[^\\#<:]++|\\.)*+", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


class Unescaped:
    """Text without its escapes, from pieces that may be cut anywhere."""

    def __init__(self):
        self.rest = ""

    def feed(self, s: str) -> str:
        s = self.rest + s
        odd = (len(s) - len(s.rstrip("\\"))) % 2
        self.rest, s = ("\\", s[:-1]) if odd else ("", s)
        return ESCAPED.sub(r"\1", s) if "\\" in s else s


class Reader:
    """One conversation, read from pieces of its formatted text: turns are found by the template's marks alone."""

    def __init__(self):
        self.turns, self.digest, self.chars = 0, hashlib.sha256(), 0
        self.said, self.said_chars, self.masked = hashlib.sha256(), 0, Unescaped()
        self.rest, self.state, self.held = "", 0, ""

    def feed(self, segment: str, loss: tuple[int, int] | None) -> None:
        self.chars += len(segment)
        if loss:
            said = self.masked.feed(segment[loss[0] : loss[1]])
            self.said_chars += len(said)
            self.said.update(said.encode())
        s, i = self.rest + segment, 0
        while i < len(s):
            if self.state == 0:  # before a turn
                if not s.startswith(OPEN, i):
                    if len(s) - i >= len(OPEN) or not OPEN.startswith(s[i:]):
                        raise ValueError("a turn must begin here")
                    break
                i, self.state = i + len(OPEN), 1
            j = PLAIN.match(s, i).end()
            text = s[i:j] if self.state == 1 else self.held + s[i:j]
            if self.state == 2:  # the line break before the closing mark belongs to the mark
                self.held = "\n" if text.endswith("\n") else ""
                text = text[: len(text) - len(self.held)]
            self.digest.update((ESCAPED.sub(r"\1", text) if "\\" in text else text).encode())
            i, mark = j, SHUT if self.state == 1 else END[1:]
            if not s.startswith(mark, i):
                if len(s) - i >= len(mark) or s[i:] != "\\" and not mark.startswith(s[i:]):
                    raise ValueError("a mark must stand here")
                break
            if self.state == 2:
                if not self.held:
                    raise ValueError("a turn must end with a line")
                self.turns += 1
                self.held = ""
            self.digest.update(b"\n")
            i, self.state = i + len(mark), (self.state + 1) % 3
        self.rest = s[i:]

    def done(self) -> tuple:
        if self.state or self.rest:
            raise ValueError("the last turn has no end")
        return self.turns, self.digest.hexdigest(), self.said_chars, self.said.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, one row each: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are dealt by conversation and sorted, and each task reads them as
    one stream of text with running digests: a conversation of any length
    needs only the memory of one batch. (A digest over one conversation is one
    task's work by its nature.) Rows whose conversation id is null are one
    conversation, with a null id.
    """
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for whole in batches:
            out = []
            for b in small_batches([whole], 64):
                for conv, seg, x, y in zip(*(b[c].to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                    if reader is None or conv != now:
                        if reader is not None:
                            out.append((now, *reader.done()))
                        now, reader = conv, Reader()
                    reader.feed(seg, None if x is None else (x, y))
            yield table(out, whole.schema.field("conv_id").type)
            kept = whole.schema.field("conv_id").type
        if reader is not None:
            yield table([(now, *reader.done())], kept)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], cols)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "part")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, schema)
