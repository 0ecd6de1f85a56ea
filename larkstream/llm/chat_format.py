"""Conversations as marked text that a deterministic parser reads back turn by turn.

A turn is an opening mark, a blank, its text, a blank and a closing mark; other roles than user, assistant
and system carry their name as well::

    <<SYS>> text <</SYS>>   [INST] text [/INST]   <s> text </s>   [ROLE] name [SAYS] text [/ROLE]

Each turn is rendered as it is and parsed again. Where the parser refuses it, or gives back another role or
text than went in, the turn holds a mark (or what looks like an escaped one): it is escaped, by a backslash
inside each such mark, and parsed again, until both are identical. Escaping adds one backslash to marks with
any number of them and reading takes one away, so it is reversible; marks hold no blanks, so none can arise
where texts and marks meet, and one escape is enough.

`format_turns` does this turn by turn, where the rows are. `read_back` goes over whole conversations, sorted
by turn, with a parser that is fed piece by piece: it holds one turn at a time, however long a conversation
is, though a conversation's hash, a chain by nature, is made in one task.

Null texts and roles are empty, turns of a null conversation are one conversation. Ties of `turn` go by role
and text; repeated rows are turns of their own. Extra columns of whatever names are carried in `record`.
Very long texts pass whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.llm.common import small_batches

#: The template's marks.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), None: ("[ROLE]", "[/ROLE]")}
SAYS = "[SAYS]"
LEARNT = "assistant"
_MARK = re.compile(r"(<<|<|\[)(\\*)(/?SYS>>|/?s>|/?INST\]|/?ROLE\]|SAYS\])")
_OPENS = {begin: (role, end) for role, (begin, end) in MARKS.items()}


class Unreadable(ValueError):
    """The text does not follow the template."""


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(role: str, text: str, escaped: bool) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    begin, end = MARKS.get(role) or MARKS[None]
    say = escape if escaped else str
    head = f"{begin} " if role in MARKS else f"{begin} {say(role)} {SAYS} "
    return f"{head}{say(text)} {end}", len(head)


class Reader:
    """Reads the template in pieces of any size."""

    def __init__(self):
        self.left, self.at = "", 0  # what is not read yet, and its place in the whole

    def feed(self, piece: str) -> list[tuple[str, str, int, int]]:
        """role, text, and where its text, escaped as it is, begins and ends in the whole, of each turn that is complete."""
        self.left += piece
        out, start = [], 0
        while turn := self._turn(start):
            *found, start = turn
            out.append(tuple(found))
        self.left, self.at = self.left[start:], self.at + start
        return out

    def end(self) -> None:
        if self.left:
            raise Unreadable(f"no end of a turn after {self.at}")

    def _marks(self, start: int) -> Iterator[re.Match]:
        return (m for m in _MARK.finditer(self.left, start) if not m[2])

    def _turn(self, start: int) -> tuple[str, str, int, int, int] | None:
        marks = self._marks(start)
        first = next(marks, None)
        if first is None:
            return None
        if first.start() != start or first[0] not in _OPENS:
            raise Unreadable(f"no turn begins at {self.at + start}")
        role, end = _OPENS[first[0]]
        begin = first.end() + 1
        if role is None:
            if not (said := next(marks, None)):
                return None
            if said[0] != SAYS:
                raise Unreadable(f"no name of a role at {self.at + start}")
            role, begin = unescape(self._between(begin, said.start())), said.end() + 1
        if not (last := next(marks, None)):
            return None
        if last[0] != end:
            raise Unreadable(f"{last[0]} inside a turn at {self.at + last.start()}")
        text = self._between(begin, last.start())
        return role, unescape(text), self.at + begin, self.at + begin + len(text), last.end()

    def _between(self, begin: int, mark: int) -> str:
        """What stands between the blanks after one mark and before the next."""
        if mark - 1 < begin or self.left[begin - 1] != " " or self.left[mark - 1] != " ":
            raise Unreadable(f"no blank beside a mark at {self.at + begin}")
        return self.left[begin : mark - 1]


def parse(text: str) -> list[tuple[str, str, int, int]]:
    reader = Reader()
    turns = reader.feed(text)
    reader.end()
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """The rendered turn, begin and end of its text there, and whether it had to be escaped."""
    for escaped in (False, True):
        piece, begin = render(role, text, escaped)
        try:
            got = parse(piece)
        except Unreadable:
            continue
        if [t[:2] for t in got] == [(role, text)]:
            return piece, got[0][2], got[0][3], escaped
    raise AssertionError("an escaped turn that does not read back")


def _text(values: pa.Array) -> list[str]:
    return ["" if v is None else v for v in values.to_pylist()]


def format_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """record, piece (the turn in the template), text_start and text_end (its text there), learnt (whether that is under the loss mask) and escaped."""
    rows = small_batches(df).select(F.struct("*").alias("record"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"))
    added = T.StructType.fromDDL("piece string, text_start int, text_end int, learnt boolean, escaped boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = _text(b.column(1))
            made = [format_turn(r, t) for r, t in zip(roles, _text(b.column(2)), strict=True)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([r == LEARNT for r in roles], pa.bool_()), pa.array([m[3] for m in made], pa.bool_())], ["record", *added.names])

    return rows.mapInArrow(run, T.StructType([rows.schema["record"], *added.fields]))


class _Digest:
    """What is read back of one conversation."""

    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n, self.learnt, self.chars = 0, 0, 0

    def take(self, piece: str, source: tuple[str, str]) -> None:
        """The next piece; what it reads back as must be the row that it was made from."""
        self.chars += len(piece)
        before = self.reader.at
        got = self.reader.feed(piece)
        if [t[:2] for t in got] != [source]:
            raise Unreadable("a turn differs from its source")
        for role, text, start, end in got:
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == LEARNT:
                masked = unescape(piece[start - before : end - before])
                self.learnt += len(masked)
                self.loss.update(masked.encode())

    def row(self, conv) -> tuple:
        self.reader.end()
        return conv, self.n, self.turns.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of `format_turns`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read from the pieces.

    A piece that reads back as anything but its row is an error.
    """
    of = lambda c: F.col("record")[c]
    rows = pieces.select(of(conv).alias("c"), of(turn).alias("n"), F.coalesce(of(role).cast("string"), F.lit("")).alias("r"), F.coalesce(of(text).cast("string"), F.lit("")).alias("t"), "piece")
    rows = rows.repartition("c").sortWithinPartitions("c", F.col("n").asc_nulls_last(), "r", "t").drop("n")
    added = T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    schema = T.StructType([T.StructField("conv_id", rows.schema["c"].dataType), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, kind = None, None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)

        for b in batches:
            done, kind = [], b.schema.field(0).type
            for c, r, t, piece in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if digest is None or c != at:
                    if digest is not None:
                        done.append(digest.row(at))
                    at, digest = c, _Digest()
                digest.take(piece, (r, t))
            if done:
                yield made(done)
        if digest is not None:
            yield made([digest.row(at)])

    return rows.mapInArrow(run, schema)
