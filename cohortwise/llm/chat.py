"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A turn is written as ``### role: text</turn>`` and a line feed. Control strings inside a text get a
backslash before their first character, and so does the backslash itself, so the text can be read back.
A part that is no text becomes an ordered placeholder ``<kind:n>`` with a reference record.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_columns

# The template.
HEAD, COLON, TAIL, LINE = "### ", ": ", "</turn>", "\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>|image:|audio:|document:|attachment:)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)

PART = "kind string, text string, ref string, width int, height int, seconds double, pages int"
_ATTACHMENT = "array<struct<n: int, kind: string, ref: string, tokens: bigint>>"
PIECES = (
    "conv_id bigint, turn bigint, role string, formatted string, loss_start bigint, loss_end bigint, "
    f"n_tokens bigint, attachments {_ATTACHMENT}"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:#<]", lambda m: "\\" + m.group(), role)


class PartVisitor:
    """Flattens the parts of one turn in order; a method per kind, ``attachment`` for kinds not known.

    Tokens: a text counts its words, an image its patches, audio its frames, a document its pages.
    """

    patch, frames_per_second, tokens_per_page, tokens_unknown = 28, 25, 512, 1

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[tuple] = []
        self.n_tokens = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('kind') or 'text'}", None)
        if method is None:
            self._place("attachment", part, self.tokens_unknown)
        else:
            method(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.n_tokens += len(text.split())

    def visit_image(self, part: dict) -> None:
        sides = [math.ceil(max(_number(part.get(s)), 1) / self.patch) for s in ("width", "height")]
        self._place("image", part, sides[0] * sides[1])

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, math.ceil(max(_number(part.get("seconds")), 0) * self.frames_per_second))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, int(max(_number(part.get("pages")), 1)) * self.tokens_per_page)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments) + 1
        self.out.append(f"<{kind}:{n}>")
        self.attachments.append((n, kind, part.get("ref"), tokens))
        self.n_tokens += tokens


def _number(value) -> float:
    return 0 if value is None or value != value else value


def format_turn(role: str | None, parts) -> tuple[str, int, int, int, list]:
    """The turn's text, the span of it that an assistant said, its tokens and attachments."""
    visitor = PartVisitor()
    for part in parts if parts is not None else ():
        if part is not None:
            visitor.visit(part)
    said = "".join(visitor.out)
    head = HEAD + escape_role(role or "") + COLON
    span = (len(head), len(head) + len(said)) if role == "assistant" else (0, 0)
    return head + said + TAIL + LINE, *span, visitor.n_tokens, visitor.attachments


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", parts_col: str | None = None,
) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, formatted, loss_start, loss_end, n_tokens, attachments``.

    The formatted conversation is the pieces of its turns by turn, role and text; the loss span counts
    code points within the piece and is empty unless the role is ``assistant``. ``parts_col`` holds
    an array of ``PART`` structs; without it ``text_col`` is one text part.

    A null or empty text is an empty part, a null role an empty one, a null part is skipped, a null part kind is text. Null
    conversation and turn are kept (a conversation of its own, the first turn). Repeated rows give
    repeated turns. Other columns are not read. No rows in, no rows out. Every row is formatted by itself, so no
    conversation is gathered.
    """
    names = [f.split()[0] for f in PART.split(", ")]
    text_part = F.array(F.struct(*[F.lit("text" if n == "kind" else None).cast("string").alias(n) if n != "text"
                                   else F.col(text_col).cast("string").alias("text") for n in names]))
    parts = F.col(parts_col) if parts_col else text_part
    chosen = rows.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"), parts.alias("parts"),
    )

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        names = ["formatted", "loss_start", "loss_end", "n_tokens", "attachments"]
        for batch in batches:
            made = [format_turn(role, parts) for role, parts in zip(batch["role"], batch["parts"])]
            columns = zip(*made) if made else [()] * len(names)
            yield {n: batch[n] for n in ("conv_id", "turn", "role")} | {n: list(c) for n, c in zip(names, columns)}

    return map_columns(chosen, kernel, PIECES)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of formatted turns; placeholders stay as they are written."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(turn.group(1)), unescape(turn.group(2))))
        at = turn.end()
    return found


_DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_COLUMNS = [field.split()[0] for field in _DIGEST.split(", ")]


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from the pieces that ``format_conversations`` wrote.

    Turns and hashes are taken from the formatted text, the loss text from the masked spans of it. The
    rows of a conversation pass one task in order, since a SHA-256 runs through its text, but as a
    stream: a worker holds one Arrow batch and the open hashes, however long the conversation is.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.length(F.regexp_replace(role, r"[\\:#<]", "##")) + len(HEAD + COLON)
    said = F.substring("formatted", head + 1, F.length("formatted") - head - len(TAIL + LINE))
    ordered = (
        pieces.select("conv_id", "turn", "formatted", "loss_start", "loss_end", role.alias("role"), F.regexp_replace(said, r"(?s)\\(.)", "$1").alias("said"))
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "said", "formatted")
        .drop("role", "said")
    )

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        opened, done = None, []
        for batch in batches:
            for conv, formatted, start, end in zip(*[batch[n] for n in ("conv_id", "formatted", "loss_start", "loss_end")]):
                if opened is None or conv != opened.conv:
                    if opened is not None:
                        done.append(opened.row())
                    opened = _Digest(conv)
                opened.add(formatted, start, end)
            if done:
                yield {n: list(c) for n, c in zip(_COLUMNS, zip(*done))}
                done = []
        if opened is not None:
            yield {n: [v] for n, v in zip(_COLUMNS, opened.row())}

    return map_columns(ordered, kernel, _DIGEST)


class _Digest:
    """The open hashes of one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.n, self.chars, self.size = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        for role, text in read_back(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        said = unescape(formatted[start:end])
        self.chars += len(said)
        self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.size += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size
