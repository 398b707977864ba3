"""Chat formatting: layouts are told by a fingerprint of their field paths and mapped to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = " </turn>\n"


@dataclass(frozen=True)
class Layout:
    """Where the turns of one kind of record are.

    ``messages`` names an array of objects holding ``role`` and ``text``; without it,
    ``fields`` lists (field, role) pairs in the order of the turns. ``paths`` are the
    field paths a record of this layout has.
    """

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()


#: Declared layouts. A record belongs to the one whose paths hash to the same value.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].text"), "dialogue", "speaker", "text"),
    Layout("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question_answer", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Layout("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Layout(
        "instruction_input", ("input", "instruction", "output"),
        fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")),
    ),
    Layout(
        "system_instruction", ("instruction", "output", "system"),
        fields=(("system", "system"), ("instruction", "user"), ("output", "assistant")),
    ),
    Layout("turn_rows", ("conv_id", "role", "text", "turn")),
)
#: Names of speakers in the layouts, and the roles they stand for.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_KNOWN = {part for lay in LAYOUTS for path in lay.paths for part in path.replace("[]", "").split(".")}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of field paths; paths through unknown fields (ids, notes) do not count."""
    known = {p for p in paths if all(part in _KNOWN for part in p.replace("[]", "").split("."))}
    return hashlib.sha256("\n".join(sorted(known)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(lay.paths): lay for lay in LAYOUTS}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Field paths of a Spark type: ``a.b`` inside structs, ``a[].b`` inside arrays of them."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _value_paths(value, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _value_paths(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for v in value:
            yield from _value_paths(v, f"{prefix}[]")
    else:
        yield prefix


def _record_fingerprints(records: pd.Series) -> pd.Series:
    def one(text):
        try:
            value = json.loads(text)
            return fingerprint(_value_paths(value)) if isinstance(value, dict) else None
        except (TypeError, ValueError, RecursionError):  # null, no JSON, or nested too deep for any layout
            return None

    return records.map(one)


def record_fingerprint(record: str) -> Column:
    """Fingerprint of each JSON record; null where it is null or no JSON object."""
    return F.pandas_udf(_record_fingerprints, T.StringType())(record)


def layout_of(df: DataFrame) -> Layout | None:
    """The layout that the columns of a table have; columns beside it do not matter."""
    paths = set(schema_paths(df.schema))
    by_size = sorted(LAYOUTS, key=lambda lay: -len(lay.paths))
    return BY_FINGERPRINT.get(fingerprint(paths)) or next((x for x in by_size if set(x.paths) <= paths), None)


def canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for known, stands_for in ROLES.items():
        out = F.when(role == known, stands_for).otherwise(out)
    return out


def _message(lay: Layout):
    def turn(m: Column) -> Column:
        return F.struct(
            canonical_role(m[lay.role]).alias("role"), F.coalesce(m[lay.text], F.lit("")).alias("text")
        )

    return turn


def canonical_turns(records: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """Turns of JSON records of any declared layout: ``conv_id, seq, role, text, layout``.

    Records of no layout give one row with a null role, text and layout, so none is lost.
    Missing or null texts are empty. Each record is read by the mapping its fingerprint
    selects; the mappings are Spark expressions.
    """
    rows = records.select(F.col(key).alias("conv_id"), F.col(record).alias("_r")).withColumn(
        "_fp", record_fingerprint("_r")
    )
    turn = "array<struct<role: string, text: string>>"
    turns = F.lit(None).cast(turn)
    name = F.lit(None).cast("string")
    for fp, lay in BY_FINGERPRINT.items():
        if lay.messages:
            item = f"array<struct<`{lay.role}`: string, `{lay.text}`: string>>"
            found = F.from_json(F.get_json_object("_r", f"$.{lay.messages}"), item)
            mapped = F.transform(found, _message(lay))
        elif lay.fields:
            mapped = F.array(*[
                F.struct(F.lit(role).alias("role"), F.coalesce(F.get_json_object("_r", f"$.{f}"), F.lit("")).alias("text"))
                for f, role in lay.fields
            ])
        else:
            continue
        mapped = mapped.cast(turn)
        turns = F.when(F.col("_fp") == fp, mapped).otherwise(turns)
        name = F.when(F.col("_fp") == fp, lay.name).otherwise(name)
    return rows.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("seq", "t")).select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "t.role", "t.text", "layout"
    )


def turn_rows(table: DataFrame) -> DataFrame:
    """Canonical turns of a table that has one row for each turn.

    Roles stay as they are; null texts and roles are empty. Rows of a conversation follow ``turn``, nulls first;
    rows that share a turn follow role and text.
    """
    layout = layout_of(table)
    if layout is None or layout.name != "turn_rows":
        raise ValueError(f"no mapping for a table with the fields {sorted(schema_paths(table.schema))}")
    return table.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def escape(text: Column) -> Column:
    """Text in which neither ``###`` nor ``</turn>`` can be found, from which the text can be told."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each turn as its piece of the formatted conversation, with the span the loss covers.

    A piece is ``### role: text </turn>`` and a line feed, with role and text escaped; a
    colon in a role is escaped too. The pieces of a conversation in the order of ``seq``
    are its formatted text. Long conversations stay as many rows as they have turns, so
    one holding a third of all rows is no single value. ``loss_start`` and ``loss_end``
    (code points in the piece, null outside the loss) mark the escaped text of the turns
    of ``loss_role``.
    """
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))
    head = F.concat(F.lit("### "), role, F.lit(": "))
    text = escape(F.col("text"))
    lossy = F.col("role") == loss_role
    start = F.when(lossy, F.char_length(head))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "seq", F.concat(head, text, F.lit(TURN_END)).alias("piece"),
        start.alias("loss_start"), (start + F.char_length(text)).alias("loss_end"),
    )


_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError(f"not a formatted turn: {piece[:80]!r}")
    return _ESCAPED.sub(r"\1", found[1]), _ESCAPED.sub(r"\1", found[2])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state = None, None

    def rows(finished: list[tuple]) -> pa.RecordBatch:
        columns = zip(*finished, strict=True) if finished else [[]] * len(DIGEST)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, DIGEST, strict=True)], schema=DIGEST
        )

    def result() -> tuple:
        n, turns, loss_chars, loss, chars = state
        return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for conv, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != current:
                if state is not None:
                    out.append(result())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_piece(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                covered = _ESCAPED.sub(r"\1", piece[a:b])
                state[2] += len(covered)
                state[3].update(covered.encode())
            state[4] += len(piece)
        yield rows(out)
    if state is not None:
        yield rows([result()])


DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted conversations hold, parsed and unescaped again: one row of digests each.

    Rows are sorted by conversation and streamed, with one running hash at a time, so the
    length of a conversation takes no memory.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id"), F.col("seq").asc_nulls_first(), "piece"
    )
    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(_digests, DIGEST_SCHEMA)
