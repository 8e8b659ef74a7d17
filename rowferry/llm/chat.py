"""Chat formatting: conversations as marked-up text with a loss mask and attachments.

A turn's content is a list of typed parts. A visitor flattens them: text is escaped, every other part
becomes a placeholder in its place, with a record of what it refers to and how many tokens it takes
once expanded. A conversation is one or more segments of text in order; each is cut between turns, so
a conversation of any length is formatted by many tasks and read back without holding it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

# The template's control strings. None can occur in an escaped text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDER = "<|{}|>"
KINDS = ("image", "audio", "document")
TRAINED = "assistant"
#: Characters of a segment, after which the next turn starts another one.
SEGMENT = 1 << 20

PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
ATTACHMENT = "struct<turn int, part int, kind string, ref string, at long, tokens long>"


def text_part(text: Column) -> Column:
    """Content of one text part."""
    none = {n: F.lit(None).cast(t) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), *[c.alias(n) for n, c in none.items()]))


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """No ``<|`` is left: each ``<``, backslashes, ``|`` gets one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role in one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@dataclass(frozen=True)
class TokenRules:
    """How many tokens a part takes when its placeholder is expanded. What a part does not tell counts as 0."""

    tile: int = 512
    tile_tokens: int = 170
    image_tokens: int = 85
    tokens_per_second: float = 25.0
    page_tokens: int = 1500


@dataclass
class Flattener:
    """Visits the parts of a turn in order; ``pieces`` are (text, is it the author's words)."""

    rules: TokenRules
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)
    size: int = 0
    said: str = ""

    def visit(self, number: int, part: dict) -> None:
        kind = part["kind"] or "text"
        if kind == "text":
            self.said += part["text"] or ""
            return
        self.end_text()
        tokens = getattr(self, f"_{kind}_tokens")(part) if kind in KINDS else 0
        self.attachments.append((number, kind, part["ref"], self.size, tokens))
        self._put(PLACEHOLDER.format(kind if kind in KINDS else "attachment"), False)

    def end_text(self) -> None:
        """Texts that follow each other are escaped as one, as a control string could span them."""
        self._put(escaped(self.said), True)
        self.said = ""

    def _put(self, text: str, own: bool) -> None:
        if text:
            self.pieces.append((text, own))
            self.size += len(text)

    def _image_tokens(self, part: dict) -> int:
        across, down = (-(-(part[side] or 0) // self.rules.tile) for side in ("width", "height"))
        return self.rules.image_tokens + across * down * self.rules.tile_tokens

    def _audio_tokens(self, part: dict) -> int:
        return int(-(-(part["seconds"] or 0) * self.rules.tokens_per_second // 1))

    def _document_tokens(self, part: dict) -> int:
        return (part["pages"] or 0) * self.rules.page_tokens


class Segment:
    """Formatted turns of one conversation."""

    def __init__(self, conv_id: str | None):
        self.conv_id, self.texts, self.size, self.turns = conv_id, [], 0, 0
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple] = []

    def add(self, role: str | None, parts: list[dict] | None, rules: TokenRules) -> None:
        flat = Flattener(rules)
        for number, part in enumerate(parts if parts is not None else ()):
            flat.visit(number, part)
        flat.end_text()
        self._put(f"{OPEN}{escaped_role(role or '')}\n")
        self.attachments += [(self.turns, n, kind, ref, self.size + at, tokens) for n, kind, ref, at, tokens in flat.attachments]
        for text, own in flat.pieces:
            if own and role == TRAINED:
                self.loss.append((self.size, self.size + len(text)))
            self._put(text)
        self._put(CLOSE)
        self.turns += 1

    def _put(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)


SEGMENT_COLUMNS = ["conv_id", "segment", "first", "last", "n_turns", "formatted", "loss_from", "loss_to", "attachments"]


def formatted(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
              content: str = "content", rules: TokenRules = TokenRules(), segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, first, last, n_turns, formatted, loss_from, loss_to, attachments) of conversations.

    One row has some turns of a conversation, in order; segments rise within it. ``first`` and ``last``
    tell whether a conversation surely begins or ends here (both true: it is whole). formatted: each
    turn as ``<|im_start|>role``, a line end, its parts, ``<|im_end|>`` and a line end. loss_from, loss_to: code points
    of the parts to learn, the texts of assistants. attachments: of each other part its turn within the segment, number,
    kind, reference, place and expanded tokens.

    ``content`` is an array of PART. Parts of an unknown kind get the placeholder ``<|attachment|>`` and
    no tokens; a NULL kind is text; NULL texts and contents are empty; a NULL role is ''. Turns are ordered by
    number (NULL first), then role, then content. Rows are dealt by ranges of conversation and turn, so a hot conversation is
    spread over tasks. Rows with a NULL conversation are one conversation. Repeated rows stay; an
    empty table gives no rows; other columns are not used.
    """
    kind = turns.schema[conversation].dataType
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(content).cast(f"array<{PART}>").alias("content"))
    hashed = F.xxhash64("content")  # equal turns are cut apart by it, without texts in the ranges
    order = ["conv_id", "turn", "role", "_hash"]
    dealt = rows.withColumn("_hash", hashed).repartitionByRange(*order).sortWithinPartitions(*order, F.col("content").asc_nulls_first())
    fields = ("conv_id string, segment long, first boolean, last boolean, n_turns int, formatted string, "
              f"loss_from array<long>, loss_to array<long>, attachments array<{ATTACHMENT}>")

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, out, held, current, begins = TaskContext.get().partitionId() << 33, [], 0, None, False

        def row(last: bool) -> tuple:
            starts, ends = zip(*current.loss) if current.loss else ((), ())
            return (current.conv_id, number, begins, last, current.turns, "".join(current.texts), list(starts), list(ends),
                    [dict(zip(("turn", "part", "kind", "ref", "at", "tokens"), a)) for a in current.attachments])

        for batch in batches:
            for conv, who, parts in zip(batch["conv_id"], batch["role"], batch["content"]):
                if current is None or conv != current.conv_id or current.size >= segment:
                    same = current is not None and conv == current.conv_id
                    if current is not None:
                        out.append(row(not same))
                        number, held = number + 1, held + current.size
                        begins = not same
                    if held >= segment or len(out) >= 1000:
                        yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)
                        out, held = [], 0
                    current = Segment(conv)
                current.add(who, parts, rules)
        if current is not None:  # the conversation may go on in the next partition
            out.append(row(False))
            yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)

    found = dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "content").mapInPandas(put_together, fields)
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}", re.S)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a segment, as they were given; placeholders stay in the text."""
    at = 0
    for found in _TURN.finditer(text):
        if found.start() != at:
            raise ValueError("not a formatted conversation")
        at = found.end()
        yield unescaped_role(found[1]), unescaped(found[2])
    if at != len(text):
        raise ValueError("not a formatted conversation")


class Digest:
    """What is told of a conversation, from its segments in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.attached, self.tokens = conv_id, 0, 0, 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, said: bytes, learnt: bytes, counts: tuple[int, ...]) -> None:
        self.said.update(said)
        self.learnt.update(learnt)
        self.count(counts)

    def count(self, counts: tuple[int, ...]) -> None:
        self.turns, self.loss_chars, self.chars, self.attached, self.tokens = (
            a + b for a, b in zip((self.turns, self.loss_chars, self.chars, self.attached, self.tokens), counts))

    def row(self, said: str | None = None, learnt: str | None = None) -> tuple:
        return (self.conv_id, self.turns, said or self.said.hexdigest(), self.loss_chars, learnt or self.learnt.hexdigest(),
                self.chars, self.attached, self.tokens)


DIGESTS = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "n_attachments long, expanded_tokens long")
_COUNTS = ["n_turns", "loss_chars", "formatted_chars", "n_attachments", "expanded_tokens"]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment read back: its turns, the text under its loss mask, counts. Of a whole conversation the
    digests take the place of the texts."""
    for batch in batches:
        rows = []
        for whole, text, starts, ends, attached in zip(batch["whole"], *(batch[c] for c in ("formatted", "loss_from", "loss_to", "attachments"))):
            turns = list(turns_of(text))
            parts = [unescaped(text[i:j]) for i, j in zip(starts, ends)]
            said, learnt = "".join(f"{who}\n{what}\n" for who, what in turns).encode(), "".join(parts).encode()
            if whole:
                said, learnt = hashlib.sha256(said).digest(), hashlib.sha256(learnt).digest()
            rows.append((whole, said, learnt, len(turns), sum(map(len, parts)), len(text), len(attached),
                         sum(a["tokens"] for a in attached)))
        yield pd.concat([batch[["conv_id", "segment"]], pd.DataFrame(rows, columns=["whole", "said", "learnt", *_COUNTS])], axis=1)


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens) of
    each conversation, read back from ``formatted`` ones.

    A digest runs over a conversation from its first turn to its last. Those of one segment are digested
    where they are; the segments of the others go through one task in order, which holds one at a time.
    """
    kind = segments.schema["conv_id"].dataType
    read = segments.select(F.col("conv_id").cast("string").alias("conv_id"), "segment", F.expr("first and last").alias("whole"),
                           "formatted", "loss_from", "loss_to", "attachments").mapInPandas(
        _read, "conv_id string, segment long, whole boolean, said binary, learnt binary, n_turns long, loss_chars long, formatted_chars long, "
               "n_attachments long, expanded_tokens long")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        current, out = None, []
        for batch in batches:
            for conv, whole, said, learnt, *counts in batch[["conv_id", "whole", "said", "learnt", *_COUNTS]].itertuples(index=False):
                if current is not None and (whole or conv != current.conv_id):
                    out.append(current.row())
                    current = None
                if whole:
                    told = Digest(conv)
                    told.count(tuple(counts))
                    out.append(told.row(said.hex(), learnt.hex()))
                    continue
                current = current or Digest(conv)
                current.add(said, learnt, tuple(counts))
            yield pd.DataFrame(out, columns=names)
            out = []
        if current is not None:
            yield pd.DataFrame([current.row()], columns=names)

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInPandas(join, DIGESTS).withColumn("conv_id", F.col("conv_id").cast(kind))
