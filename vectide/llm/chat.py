"""Chat formatting by schema fingerprints.

The nested field paths of a record that belong to any known layout are sorted
and hashed; the fingerprint selects a declarative mapping from that layout to
canonical turns (role, text).  Turns become pieces of a template whose control
strings are escaped, reversibly, wherever a role or a text holds them.
Conversations are streams of pieces in turn order: a task formats, reads back
or hashes one piece at a time, so a conversation's length needs no memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings: those of our template and of other common ones.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|line|>")
_START, _END, _LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
_RISK = re.compile("|".join([r"\\", *sorted(map(re.escape, CONTROL), key=len, reverse=True)]))
_ESCAPED = re.compile(r"\\(\\?)")

#: Layouts: where the turns are, and how a turn is read.  A path is dotted, [] goes through a list.
#: `list`: field with a list of turns, of which `role` and `text` are fields.  `turns`: one turn for each
#: (role, field) whose field has text; two fields joined by a line if both have.  `row`: the record is a turn.
LAYOUTS: dict[str, dict] = {
    "turn rows": {"row": {"role": "role", "text": "text"}, "paths": ["role", "text"]},
    "messages": {"list": "messages", "role": "role", "text": "content", "paths": ["messages[].role", "messages[].content"]},
    "conversations": {"list": "conversations", "role": "from", "text": "value", "paths": ["conversations[].from", "conversations[].value"]},
    "nested chat": {"list": "chat.turns", "role": "author.role", "text": "body.text", "paths": ["chat.turns[].author.role", "chat.turns[].body.text"]},
    "prompt": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])], "paths": ["prompt", "completion"]},
    "prompt response": {"turns": [("user", ["prompt"]), ("assistant", ["response"])], "paths": ["prompt", "response"]},
    "system prompt": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])], "paths": ["system", "prompt", "response"]},
    "instruction": {"turns": [("user", ["instruction"]), ("assistant", ["output"])], "paths": ["instruction", "output"]},
    "instruction input": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])], "paths": ["instruction", "input", "output"]},
    "question answer": {"turns": [("user", ["question"]), ("assistant", ["answer"])], "paths": ["question", "answer"]},
}
#: Names of roles in some layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    """Hash of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_KNOWN = {p for layout in LAYOUTS.values() for p in layout["paths"]}
_BY_PRINT = {fingerprint(layout["paths"]): name for name, layout in LAYOUTS.items()}


def paths_of(record, prefix: str = "") -> set[str]:
    """Dotted paths of the leaves of a parsed record."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in paths_of(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(record, list):
        return {p for v in record for p in paths_of(v, prefix + "[]")}
    return {prefix}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """The same of a Spark type."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return {prefix}


def layout_of(paths: set[str]) -> str | None:
    """The layout with exactly those of the known paths; fields that no layout knows don't matter."""
    return _BY_PRINT.get(fingerprint(paths & _KNOWN))


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) turns of a parsed record; None if no layout fits.  Null roles and texts are empty."""
    layout = LAYOUTS.get(layout_of(paths_of(record)) or "")
    if layout is None:
        return None
    if "row" in layout:
        turns = [(_at(record, layout["row"]["role"]), _at(record, layout["row"]["text"]))]
    elif "list" in layout:
        turns = [(_at(x, layout["role"]), _at(x, layout["text"])) for x in _at(record, layout["list"]) or []]
    else:
        turns = [(role, "\n".join(x for x in map(_text, (_at(record, f) for f in fields)) if x)) for role, fields in layout["turns"]]
        turns = [(r, t) for r, t in turns if t or r != "system"]
    return [(ROLES.get(_text(r), _text(r)), _text(t)) for r, t in turns]


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one behind its first character."""
    return _RISK.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and start and length of its loss mask (assistant texts)."""
    head = _START + escape(role).replace("\n", _LINE) + "\n"  # a role stays on its line
    body = escape(text)
    return head + body + _END + "\n", len(head), len(body) if role == "assistant" else 0


def read_piece(formatted: str) -> tuple[str, str]:
    """(role, text) back from a piece."""
    if not formatted.startswith(_START) or not formatted.endswith(_END + "\n"):
        raise ValueError("not a piece of the template")
    role, _, body = formatted[len(_START) : -len(_END) - 1].partition("\n")
    return unescape(role.replace(_LINE, "\n")), unescape(body)


def to_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Records held as JSON text to rows id, turn, role, text, layout.

    A record that is null, no JSON object, or of no known layout gives one row
    with null turn, role and text and the layout `unknown`; no record is lost.
    """
    out = "id string, turn long, role string, text string, layout string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, text in zip(b["id"].to_pylist(), b["record"].to_pylist(), strict=True):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                turns = canonical(record) if isinstance(record, dict) else None
                name = layout_of(paths_of(record)) if turns is not None else "unknown"
                rows += [(ident, k, r, t, name) for k, (r, t) in enumerate(turns)] if turns else [(ident, None, None, None, name)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("record")).mapInArrow(run, out)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Records of any known layout, as columns, to rows conv_id, turn, role, text.

    The table's own field paths are fingerprinted; the fingerprint selects the
    mapping, and the mapping is applied as column expressions.  Null roles and
    texts are empty.  A record of turn rows keeps its turn; turns of a list, or
    of fields, are numbered, and a record without any gives no row.
    """
    layout = LAYOUTS.get(layout_of(schema_paths(records.schema)) or "")
    if layout is None:
        raise ValueError("the columns match no known layout")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long").alias("conv_id")
    if "row" in layout:
        own = layout["row"]
        turns = records.select(ident, F.col(turn_col).cast("long").alias("turn"), text(F.col(own["role"])).alias("role"), text(F.col(own["text"])).alias("text"))
    elif "list" in layout:
        each = records.select(ident, F.posexplode(layout["list"]).alias("turn", "said"))
        turns = each.select("conv_id", F.col("turn").cast("long").alias("turn"), text(F.col("said." + layout["role"])).alias("role"), text(F.col("said." + layout["text"])).alias("text"))
    else:
        joined = lambda fields: F.concat_ws("\n", *(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields))
        said = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), joined(f).alias("text")) for r, f in layout["turns"])), lambda x: (x["text"] != "") | (x["role"] != "system"))
        turns = records.select(ident, F.posexplode(said).alias("turn", "said")).select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")
    if "row" in layout:  # rows of turns carry the names of roles as they are
        return turns
    named = F.col("role")
    for k, v in ROLES.items():
        named = F.when(F.col("role") == k, v).otherwise(named)
    return turns.withColumn("role", named)


_PIECES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])


def format_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Records of any known layout to formatted pieces: conv_id, turn, role, formatted, loss_start, loss_length.

    A conversation's output is its pieces in order of turn, then role and text;
    null turns come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [piece(r, t) for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([b["conv_id"], b["turn"], b["role"], *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))], schema=_PIECES)

    return canonical_turns(records, id_col, turn_col).mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss_start long, loss_length long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame) -> DataFrame:
    """A row of counts and digests for each conversation, read from the formatted pieces alone.

    Pieces of a conversation meet in one task, sorted by turn, role and text, and
    are hashed as they pass; none is kept.  A null conv_id is a conversation of
    its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for b in batches:
            for ident, formatted, start, length in zip(*(b[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")), strict=True):
                if now is None or now[0] != ident:
                    if now is not None:
                        close()
                    now = [ident, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_piece(formatted)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[start : start + length])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
            if len(done) >= 5000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
                done = []
        if now is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    # the text again: what stands between the first line and the end, without the escapes' backslashes
    head = F.instr("formatted", "\n")
    body = F.substring(F.col("formatted"), head + 1, F.length("formatted") - head - len(_END) - 1)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.regexp_replace(body, r"\\(\\?)", "$1"))
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
