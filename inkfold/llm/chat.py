"""Chat formatting by schema fingerprints.

A record is a JSON object in some layout: one turn, a prompt with its response, an instruction with input and output,
or a list of messages. The nested field paths of a record, sorted and hashed, are its schema fingerprint; the
fingerprint selects a declarative mapping, which says where role and text of each turn stand. Optional fields that
a record lacks have fingerprints of their own, so every layout is listed with each set of fields it may have.
A record of an unknown fingerprint goes to the side table ``rejected``.

Template: ``### role: text </turn>`` and a line end for each turn. In roles and texts a backslash, ``#``, ``<``, ``:`` (in roles)
and a line end (in roles) are written as ``\\\\``, ``\\h``, ``\\l``, ``\\c`` and ``\\n``, so neither turn mark can stand inside a text, and
what is read back is what went in. The loss mask of a turn is a span of the formatted text: that of an assistant's text.

A conversation's turns are segments in order; nothing holds a conversation as a whole. Segments are sorted in their
partition and read one after the other, with running digests as the only state.

Defined cases: a null text or role is an empty one; turns of equal number follow the order of their segments; a null turn number comes
first; rows of a null conv_id are one conversation; repeated rows are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
_TEXT_OUT = str.maketrans({"\\": "\\\\", "#": "\\h", "<": "\\l"})
_ROLE_OUT = str.maketrans({"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"})
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ([^:]*): ([^<]*) </turn>\n")


def escape(text: str) -> str:
    return text.translate(_TEXT_OUT)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and start and length of the part under the loss mask (length -1: none)."""
    head = OPEN + role.translate(_ROLE_OUT) + AFTER_ROLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(body) if role == LEARNED else -1


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("not a turn of this template")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


# --- layouts -----------------------------------------------------------------------------
def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; the elements of a list share one step."""
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            out |= paths(v, f"{prefix}.{k}") or {f"{prefix}.{k}"}
        return out
    if isinstance(value, list):
        return set().union(*[paths(v, f"{prefix}[]") for v in value]) or {f"{prefix}[]"}
    return {prefix} if prefix else set()


def schema_fingerprint(value) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths(value))))


def _mappings() -> dict[int, tuple]:
    """Fingerprint to (kind, steps). A step is (role or path of the role, path of the text)."""
    layouts = [
        # fields that are always there, fields that may be missing, turns as (role, path) or a list with paths of role and text
        ([".conv_id", ".turn", ".prompt"], [], [("user", ".prompt")]),
        ([".conv_id", ".turn", ".response"], [], [("assistant", ".response")]),
        ([".conv_id", ".turn", ".message.role", ".message.content"], [], [(".message.role", ".message.content")]),
        ([".conv_id", ".turn", ".message.content"], [], [("", ".message.content")]),
        ([".conv_id"], [".prompt", ".response"], [("user", ".prompt"), ("assistant", ".response")]),
        ([".conv_id", ".instruction"], [".input", ".output"], [("user", ".instruction"), ("user", ".input"), ("assistant", ".output")]),
        ([".conv_id", ".messages[].role", ".messages[].content"], [], [(".messages[].role", ".messages[].content")]),
        ([".conv_id", ".conversations[].from", ".conversations[].value"], [], [(".conversations[].from", ".conversations[].value")]),
        ([".conv_id", ".question", ".answer"], [".system"], [("system", ".system"), ("user", ".question"), ("assistant", ".answer")]),
    ]
    out: dict[int, tuple] = {}
    ids = [".conv_id", ".turn"]
    for fixed, optional, steps in layouts:
        for n in range(len(optional) + 1):
            for some in combinations(optional, n):
                there = tuple(s for s in steps if s[1] in some or s[1] not in optional)
                bare = [p for p in [*fixed, *some] if p not in ids]
                for named in ids, ids[:1], ids[1:], []:  # an identifier may be missing too
                    found = xxhash.xxh64_intdigest("\n".join(sorted([*bare, *named])))
                    if there:
                        out.setdefault(found, there)
    return out


MAPPINGS = _mappings()
#: Names that layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


def _at(value, path: str):
    for step in path.split(".")[1:]:
        value = value.get(step) if isinstance(value, dict) else None
    return value


def turns(record: dict) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record, or None for an unknown layout."""
    steps = MAPPINGS.get(schema_fingerprint(record))
    if steps is None:
        return None
    out = []
    for role, text in steps:
        if "[]" in text:
            outer, inner = text.split("[]")
            _, inner_role = role.split("[]")
            for item in _at(record, outer) or []:
                name = _at(item, inner_role) or ""
                out.append((ROLE_NAMES.get(name, name) if ".from" in inner_role else name, _at(item, inner) or ""))
        else:
            out.append(((_at(record, role) or "") if role.startswith(".") else role, _at(record, text) or ""))
    return out


# --- jobs --------------------------------------------------------------------------------
SEGMENTS = "conv_id long, turn long, part int, segment string, loss_start int, loss_length int, rejected string"


def format_records(records: DataFrame) -> DataFrame:
    """Column ``record`` (JSON objects) to segments; a record of no known layout gives a row with ``rejected`` alone."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                made = turns(record) if isinstance(record, dict) else None
                if made is None:
                    out.append((None, None, None, None, None, None, raw if raw is not None else ""))
                    continue
                for part, (role, text) in enumerate(made):
                    out.append((record.get("conv_id"), record.get("turn"), part, *segment(role, text), None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            names = ["conv_id", "turn", "part", "segment", "loss_start", "loss_length", "rejected"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return records.select("record").mapInArrow(run, SEGMENTS)


def row_records(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as records: a user's turn is a prompt, an assistant's a response, any other a message."""
    message = lambda field: F.struct("conv_id", "turn", F.coalesce("text", F.lit("")).alias(field))
    other = F.struct("conv_id", "turn", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("message"))
    return rows.select(F.when(F.col("role") == "user", F.to_json(message("prompt"))).when(F.col("role") == "assistant", F.to_json(message("response"))).otherwise(F.to_json(other)).alias("record"))


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation of formatted segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        now, state = None, None

        def row():
            n, all_turns, chars, loss, size = state
            return (now[0], n, all_turns.hexdigest(), chars, loss.hexdigest(), size)

        def batch_of(out):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for conv, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if length >= 0:
                    learned = unescape(text[start : start + length])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield batch_of(out)
        if now:
            yield batch_of([row()])

    ordered = segments.where("rejected IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
