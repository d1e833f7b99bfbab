"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  Nothing about it
is assumed: the conversation is rendered up to every turn, each output is
compared with the one before, and what was added is the new turn's segment.  If
an output does not begin with the previous one, the template rewrites history
(drops earlier parts, for instance); such conversations are rendered once more
as a whole, and the spans come from substituting one turn's text at a time.

A turn's *text* span inside its segment is where two renderings with different
probe texts for that turn differ; the loss mask covers exactly the text spans
of the assistant's turns.

Rows of a conversation are brought together and sorted by one shuffle and then
read as a stream.  A worker keeps the turns and segments of one conversation and
renders every prefix from its first turn on, whatever its length; the work grows
with the square of a conversation's turns.

A template may declare with the attribute ``stateless = True`` that what a turn
adds depends on that turn alone (besides what the first one opens).  Only then
are prefixes beyond ``window`` turns rendered from the first turn and the last
``window - 1``, and only these are kept, so that a conversation of any length
takes bounded memory; a declared template found rewriting history is an error.

Defined cases: a null text or role is empty; turns are ordered by number (null
last), ties by role, then text; repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]                       # role, text
Template = Callable[[list[Turn]], str]

# The control strings of the instruction template.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BOS, EOS, OPEN, CLOSE)
LOSS_ROLE = "assistant"


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """``text`` without any control string: a backslash after the first character of each, backslashes doubled."""
    text = text.replace("\\", "\\\\")
    for c in controls:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    if "\\" not in text:
        return text
    out, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        out.append(text[k:at])
        k = at + 1
        if text[k:k + 1] == "\\":
            out.append("\\")
            k += 1
    out.append(text[k:])
    return "".join(out)


def instruction_template(turns: list[Turn]) -> str:
    """``<s>``, then per turn ``[INST] role [/INST] text</s>``, role and text escaped."""
    return BOS + "".join(f"{OPEN} {escape(role)} {CLOSE} {escape(text)}{EOS}" for role, text in turns)


instruction_template.stateless = True


def parse_instruction(text: str) -> list[Turn]:
    """The turns of an output of ``instruction_template`` (control strings outside escapes only)."""
    if not text.startswith(BOS):
        raise ValueError("no start mark")
    out, k = [], len(BOS)
    while k < len(text):
        if not text.startswith(OPEN + " ", k):
            raise ValueError("no turn mark")
        a = text.index(f" {CLOSE} ", k)
        b = text.index(EOS, a)
        out.append((unescape(text[k + len(OPEN) + 1:a]), unescape(text[a + len(CLOSE) + 2:b])))
        k = b + len(EOS)
    return out


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Segment:
    """What one turn added: ``text`` of the output, the turn's own text at ``begin:end`` inside it."""
    text: str
    begin: int
    end: int
    rewrites: bool


_PROBES = ("\ue000", "\ue001")               # private-use characters, one apiece


def text_span(template: Template, turns: list[Turn], k: int, output: str) -> tuple[int, int]:
    """Where turn ``k``'s text stands in ``output = template(turns)``; (n, n) if the output does not show it."""
    role = turns[k][0]
    a, b = (template([*turns[:k], (role, x), *turns[k + 1:]]) for x in _PROBES)
    begin = common_prefix(a, b)
    if begin == len(a):
        return len(output), len(output)
    return begin, len(output) - (len(a) - begin - len(_PROBES[0]))


def next_segment(template: Template, before: list[Turn], last: str | None, turn: Turn) -> tuple[Segment, str]:
    """The segment that ``turn`` adds after the turns ``before``, whose output was ``last``; and the new output."""
    turns = [*before, turn]
    output = template(turns)
    kept = 0 if last is None else common_prefix(last, output)
    begin, end = text_span(template, turns, len(turns) - 1, output)
    return Segment(output[kept:], max(begin - kept, 0), max(end - kept, 0), last is not None and kept < len(last)), output


def whole_spans(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Final output and every turn's text span in it, for templates that rewrite history."""
    output = template(turns)
    return output, [text_span(template, turns, k, output) for k in range(len(turns))]


SEGMENTS = ("conv_id long, turn_no long, role string, segment string, start long, text_start long, text_end long, "
            "loss boolean, rewrites boolean")
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("start", pa.int64()),
                       ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])
_FLUSH = 2000                                # rows of an output batch


def _turn_rows(batches) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())


def _rendered(template: Template, window: int | None):
    """``window``: most turns to render at once, for a stateless template; None keeps them all."""
    def conversation(conv, turns: Iterator[Turn]):
        kept: list[Turn] = []
        last, start, rewritten = None, 0, False
        rows = []
        for count, turn in enumerate(turns):
            if window is not None and len(kept) >= window:    # render on from the first and the latest turns
                kept = [kept[0], *kept[2:]]
                last = template(kept)
            s, last = next_segment(template, kept, last, turn)
            kept.append(turn)
            if s.rewrites and window is not None:
                raise ValueError(f"the template declares itself stateless and rewrites history at turn {count}")
            rewritten |= s.rewrites
            rows.append((conv, count, turn[0], s.text, start, start + s.begin, start + s.end, turn[0] == LOSS_ROLE, s.rewrites))
            start += len(s.text)
            if window is not None:
                yield from rows
                rows = []
        if rewritten:                                     # segments no longer add up: the whole output, cut before each text
            output, spans = whole_spans(template, kept)
            flags = [r[8] for r in rows]
            least = list(accumulate((a for a, _ in reversed(spans)), min))[::-1]
            cuts = [0, *[max(a, 0) for a in least[1:]], len(output)]
            rows = [(conv, k, kept[k][0], output[cuts[k]:cuts[k + 1]], cuts[k], *spans[k], kept[k][0] == LOSS_ROLE, flags[k])
                    for k in range(len(kept))]
        yield from rows

    def run(batches):
        rows = _turn_rows(batches)
        out = []
        row = next(rows, None)
        while row is not None:
            conv = row[0]

            def turns():
                nonlocal row
                while row is not None and row[0] == conv:
                    turn = (row[1], row[2])
                    row = next(rows, None)
                    yield turn
            for r in conversation(conv, turns()):
                out.append(r)
                if len(out) >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SEGMENTS.types)], schema=_SEGMENTS)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SEGMENTS.types)], schema=_SEGMENTS)
    return run


def format_conversations(conversations: DataFrame, template: Template = instruction_template, window: int = 32) -> DataFrame:
    """One row per turn, in order: its segment of the formatted text and its spans in it (code points).

    A conversation's formatted text is its segments joined; rows of one
    conversation are adjacent and ordered inside one partition.  ``window`` is
    for templates that declare themselves ``stateless``; others render every
    prefix in full.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.mapInArrow(_rendered(template, window if getattr(template, "stateless", False) else None), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.all, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0
        self.rewrites = False
        self.head = BOS

    def add(self, segment, start, a, b, loss, rewrites):
        """Read one turn back from the formatted text alone."""
        self.chars += len(segment)
        self.rewrites |= rewrites
        (role, text), = parse_instruction(segment if segment.startswith(BOS) else BOS + segment)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        if loss:
            masked = unescape(segment[a - start:b - start])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self):
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites)


def _digests(batches):
    now = None
    for batch in batches:
        out = []
        for conv, segment, start, a, b, loss, rewrites in zip(*(batch.column(n).to_pylist() for n in (
                "conv_id", "segment", "start", "text_start", "text_end", "loss", "rewrites"))):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(segment, start, a, b, loss, rewrites)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DIGESTS.types)], schema=_DIGESTS)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[now.row()]), _DIGESTS.types)], schema=_DIGESTS)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, parsed back from the rows of ``format_conversations`` (instruction template)."""
    return segments.mapInArrow(_digests, DIGESTS)
