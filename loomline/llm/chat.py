"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the assistant's texts are intersected with the
token spans by binary search. Marks are single tokens, so no token crosses the edge of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, rows_of

#: The marks of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: A longer conversation is encoded in runs of whole turns of about so many characters: marks are tokens of their own, so the tokens
#: are those of the whole.
RUN_CHARS = 2 << 20

_ESCAPE, _UNESCAPE = re.compile(r"\\|(?<=<)\|"), re.compile(r"\\(.)", re.S)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and before a bar after <: no mark remains. unescape() takes them away."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the spans of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == LOSS_ROLE and body:
            spans.append((at, at + len(body)))
        parts += [head, body, END]
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of sorted starts and ends) overlap the sorted spans."""
    mask = np.zeros(len(offsets) + 1, np.int8)
    if len(spans) and len(offsets):
        s = np.array(spans)
        first, last = np.searchsorted(offsets[:, 1], s[:, 0], "right"), np.searchsorted(offsets[:, 0], s[:, 1], "left")
        np.add.at(mask, first, 1)
        np.add.at(mask, last, -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of masked tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [unescape(formatted[offsets[a, 0] : offsets[b - 1, 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


@dataclass
class Digest:
    """What one conversation's output comes to, turn by turn."""

    conv_id: int | None
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    n_tokens: int = 0
    loss_tokens: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, encoder, turns: list[tuple[str, str]]) -> None:
        formatted, spans = render(turns)
        offsets = np.array(encoder.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in masked_text(formatted, offsets, mask):
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(formatted)
        self.n_tokens += len(mask)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_tokens, self.loss_tokens)


def ordered(conversations: DataFrame) -> DataFrame:
    """The turns of a conversation together and in order: by turn (null first), role, text."""
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row for each run of turns: conv_id, run, formatted, token_ids, mask. One run holds a whole conversation of up to RUN_CHARS; a longer
    one is encoded in several runs of whole turns, with the same tokens. Null texts and roles are empty; a null conv_id is a conversation;
    null turns come first; repeated rows are turns of their own; a very long text is in one run. Other columns, whatever their names, are
    left out. An empty table gives no rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int32()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for conv, k, turns in runs(batches):
            formatted, spans = render(turns)
            encoded = encoder.encode(formatted, add_special_tokens=False)
            mask = loss_mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
            yield batch_of([(conv, k, formatted, encoded.ids, mask.tolist())], schema)

    return map_batches(ordered(conversations), run, "conv_id bigint, run int, formatted string, token_ids array<int>, mask array<boolean>")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conversation, number of the run, its turns) from ordered rows."""
    now, number, turns, size = object(), 0, [], 0
    for b in batches:
        for conv, _, role, text in rows_of(b):
            if conv != now:
                if turns:
                    yield now, number, turns
                now, number, turns, size = conv, 0, [], 0
            elif size >= RUN_CHARS:
                yield now, number, turns
                number, turns, size = number + 1, [], 0
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield now, number, turns


def digests(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens, read back from the output.

    Null texts and roles are empty; a null conv_id is a conversation, and null turns come first; repeated rows are turns of their own.
    A conversation's turns stream through one task, a run of turns in memory at a time, as its digests need their order. Other
    columns, whatever their names, are left out. An empty table gives no rows.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")
    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        digest, rows = None, []
        for conv, k, turns in runs(batches):
            if k == 0:
                if digest:
                    rows.append(digest.row())
                digest = Digest(conv)
                if len(rows) >= 1000:
                    yield batch_of(rows, schema)
                    rows = []
            digest.add(encoder, turns)
        if digest:
            yield batch_of([*rows, digest.row()], schema)

    return map_batches(ordered(conversations), run, ", ".join(f"{n} {'string' if 'sha256' in n else 'bigint'}" for n in names))
