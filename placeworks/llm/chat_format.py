"""Chat formatting by grammar round trip.

A turn is rendered, the rendered text is parsed again by a deterministic
parser, and the recovered turn is compared with the source. Where they differ
the text holds something that the grammar would take for its own, or for an
escape; that content is escaped, and the round goes on until both are
identical. A turn's markup delimits itself, so the turns of a conversation,
parsed one after the other, are the turns of its text.

The grammar, with T for an escaped text and R for an escaped role:

    user         [INST] T [/INST]
    assistant    <s>T</s>
    system       <<SYS>>T<</SYS>>
    any other    [ROLE]R[/ROLE]T[/END]

A control string inside a text gets a backslash after its first character,
and so does one that has backslashes there already, one more: `[INST]` is
`[\\INST]`, `[\\INST]` is `[\\\\INST]`. Taking one away gives the text back.

Conversations are laid out in pieces of about PIECE code points, cut between
turns, so a conversation of any length is rows of bounded size in order. Rows
are dealt by ranges of (conversation, turn): one that holds a third of all
turns is formatted and parsed by many tasks. Only its digest runs over its
pieces one after the other, since a digest has no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import sliced, task

#: Code points after which a piece ends with its turn.
PIECE = 1 << 16

#: Opening and closing of the roles that have markup of their own.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE = ("[ROLE]", "[/ROLE]", "[/END]")
LOSS_ROLE = "assistant"

# A control string, perhaps with backslashes after its first character.
_TAIL = r"(?:(?<=<)\\*(?=/?s>|</?SYS>>)|(?<=\[)\\*(?=/?(?:INST|ROLE|END)\]))"
_ANY = re.compile(_TAIL)
_ESCAPED = re.compile(_TAIL.replace(r"\\*", r"\\+"))
_CONTROL = re.compile(r"</?s>|<</?SYS>>|\[/?(?:INST|ROLE|END)\]")


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[1:], text)


class GrammarError(ValueError):
    """A text that the grammar does not give."""


def render(role: str, body: str, name: str) -> tuple[str, int]:
    """A turn's text, its body and its role's name as they are; and where the body starts."""
    if role in MARKS:
        start, end = MARKS[role]
        return start + body + end, len(start)
    start = ROLE[0] + name + ROLE[1]
    return start + body + ROLE[2], len(start)


def _until(text: str, at: int, end: str) -> tuple[str, int]:
    stop = text.find(end, at)
    if stop < 0:
        raise GrammarError(f"no {end!r} after {at}")
    body = text[at:stop]
    if _CONTROL.search(body):
        raise GrammarError(f"a control string inside a text after {at}")
    return unescape(body), stop + len(end)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    at = 0
    while at < len(text):
        for role, (start, end) in MARKS.items():
            if text.startswith(start, at):
                body, at = _until(text, at + len(start), end)
                break
        else:
            if not text.startswith(ROLE[0], at):
                raise GrammarError(f"no turn starts at {at}")
            role, at = _until(text, at + len(ROLE[0]), ROLE[1])
            if role in MARKS:
                raise GrammarError(f"role {role!r} has markup of its own")
            body, at = _until(text, at, ROLE[2])
        yield role, body


def _recovered(text: str) -> list[tuple[str, str]] | None:
    try:
        return list(parse(text))
    except GrammarError:
        return None


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text as it comes back whole from the parser, and the start and end of its body there."""
    name, body = role, text
    while True:
        out, start = render(role, body, name)
        if _recovered(out) == [(role, text)]:
            return out, start, start + len(body)
        if (name, body) != (role, text):
            raise GrammarError(f"a turn that no escape brings back: {role!r}, {text[:80]!r}")
        name, body = escape(role), escape(text)


PIECES = "conv_id long, place long, whole boolean, text string, loss_start array<long>, loss_end array<long>"


@task
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows that come sorted by conversation and turn."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
        ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())),
    ])
    done: list[dict] = []
    size = 0
    piece: dict | None = None
    parts: list[str] = []
    length, n_pieces, n_convs = 0, 0, 0
    place = TaskContext.get().partitionId() << 32

    def close(ended: bool) -> None:
        # The first and the last conversation of a task may go on in other tasks.
        nonlocal size
        piece["text"] = "".join(parts)
        piece["whole"] = ended and n_pieces == 1 and n_convs > 1
        done.append(piece)
        size += len(piece["text"])

    for batch in sliced(batches, 256):
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            other = piece is None or conv_id != piece["conv_id"]
            if piece is not None and (other or length >= PIECE):
                close(other)
            if other:
                n_convs, n_pieces = n_convs + 1, 0
            if other or length >= PIECE:
                piece = {"conv_id": conv_id, "place": place, "loss_start": [], "loss_end": []}
                parts, length, n_pieces, place = [], 0, n_pieces + 1, place + 1
            out, start, end = formatted_turn(role, text)
            if role == LOSS_ROLE:
                piece["loss_start"].append(length + start)
                piece["loss_end"].append(length + end)
            parts.append(out)
            length += len(out)
            if size > 16 * PIECE:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
    if piece is not None:
        close(False)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def formatted(conversations: DataFrame) -> DataFrame:
    """The formatted pieces (PIECES) of conversations (conv_id, turn, role, text); those of a conversation go by `place`.

    text is a piece's formatted text, loss_start and loss_end are the code
    points of the loss mask in it: the escaped texts of assistant turns. A null
    text or role is empty; turns go by `turn`, null first, and rows of one turn
    by role, then by the md5 of the text. A null conv_id is a conversation of
    its own. Other columns are ignored; no rows give no pieces.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("md5"), text.alias("text"),
    )
    order = ["conv_id", "turn", "role", "md5"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, PIECES)


class _Told:
    """What is told of a conversation, turn by turn."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        for role, body in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        for start, end in zip(starts, ends, strict=True):
            body = unescape(text[start:end])
            self.loss_chars += len(body)
            self.loss.update(body.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


TOLD = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TOLD_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


@task
def _told_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pieces that are a conversation tell; other pieces as they are."""
    for batch in sliced(batches, 256):
        rows = batch.to_pylist()
        for r in rows:
            if r["whole"]:
                told = _Told(r["conv_id"])
                told.add(r["text"], r["loss_start"], r["loss_end"])
                r |= told.row() | {"text": None, "loss_start": None, "loss_end": None}
        extra = [f for f in _TOLD_SCHEMA if f.name != "conv_id"]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([*batch.schema, *extra]))


@task
def _told_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, of pieces that come in order."""
    told: _Told | None = None
    for batch in sliced(batches, 64):
        out = []
        for r in batch.to_pylist():
            if told is not None and (r["whole"] or r["conv_id"] != told.conv_id):
                out.append(told.row())
                told = None
            if r["whole"]:
                out.append({f.name: r[f.name] for f in _TOLD_SCHEMA})
                continue
            told = told or _Told(r["conv_id"])
            told.add(r["text"], r["loss_start"], r["loss_end"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _TOLD_SCHEMA)
    if told is not None:
        yield pa.RecordBatch.from_pylist([told.row()], _TOLD_SCHEMA)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces tell of each conversation (TOLD): parsed turns, and the unescaped text under the loss mask.

    Pieces that hold a whole conversation are told of where they are; the
    others meet by conversation, in order.
    """
    told = pieces.mapInArrow(_told_whole, PIECES + TOLD.removeprefix("conv_id long"))
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_told_on, TOLD)
