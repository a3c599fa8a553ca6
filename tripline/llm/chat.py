"""Chat formatting by assembly of token ids.

A conversation becomes the token ids of a template and a loss mask. Every
segment of text is encoded by itself and the template's control strings are
spliced in as reserved ids above the vocabulary, so no text can produce one.
Positions and the mask come from prefix sums over the segments. Control strings
that occur inside a text are escaped, so the formatted text can be read
back too: a backslash is put behind the opening bracket, and one more where a
text already holds that form.

Template: ``<s>`` opens a conversation; a turn is ``[INST]`` text ``[/INST]`` for a
user, ``[SYS]`` text ``[/SYS]`` for a system message, ``[BOT]`` text ``</s>`` for an
assistant, and ``[ROLE]`` role ``[TEXT]`` text ``[/TEXT]`` for any other role. The loss
mask covers the text of assistant turns.

Turns are rows in the order of ``turn`` (NULL first; ties by role, then text). NULL
roles and texts are empty strings; a NULL conversation id is a conversation
of its own. The output has a row for each turn, so it is bounded by a turn and
not by a conversation; rows of a conversation stand together, in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[BOT]", "[ROLE]", "[TEXT]", "[/TEXT]")
BEGIN, END = "<s>", "</s>"
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[BOT]", END)}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
TRAINED = "assistant"
_OPENED = {opening: role for role, (opening, _) in TURNS.items()}
_INNER = "|".join(sorted({re.escape(control[1:]) for control in CONTROLS}))
_PLAIN = re.compile(rf"([<\[])(\\*)({_INNER})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_INNER})")
#: What Spark and DuckDB SQL call the same pattern.
ESCAPE_PATTERN = _PLAIN.pattern


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Codec:
    """Encodes segments with a byte-level tokenizer, whose decoding gives the text back."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = True
        self.first_reserved = self._tokenizer.get_vocab_size()
        self.reserved = {control: self.first_reserved + number for number, control in enumerate(CONTROLS)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self._tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(tokenizer_path: str) -> Codec:
    """The codec of this process."""
    if tokenizer_path not in _CODECS:
        _CODECS[tokenizer_path] = Codec(tokenizer_path)
    return _CODECS[tokenizer_path]


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """A turn as pieces: the string, whether it is a control string, whether the loss covers it."""
    if role in TURNS:
        opening, closing = TURNS[role]
        return [(opening, True, False), (escape(text), False, role == TRAINED), (closing, True, False)]
    start, middle, closing = OTHER
    return [(start, True, False), (escape(role), False, False), (middle, True, False), (escape(text), False, False),
            (closing, True, False)]


def assemble(pieces: list[tuple[str, bool, bool]], encoded: Iterator[list[int]], reserved: dict[str, int]):
    """Ids of the pieces one after the other and their loss mask, by prefix sums of their lengths."""
    lists = [[reserved[piece]] if control else next(encoded) for piece, control, _ in pieces]
    ends = list(accumulate(map(len, lists)))
    edges = np.zeros(ends[-1] + 1, dtype=np.int8)
    for (_, _, trained), ids, end in zip(pieces, lists, ends):
        if trained:
            edges[end - len(ids)] += 1
            edges[end] -= 1
    return np.array([token for ids in lists for token in ids], dtype=np.int32), np.cumsum(edges[:-1]).astype(np.int8)


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.ByteType())),
    ]
)
_ROWS_AT_ONCE = 256


def _format(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        current, position, started = None, 0, False
        for whole in batches:
            for offset in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(offset, _ROWS_AT_ONCE)
                conversations, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
                turns = [segments(role, text) for role, text in zip(roles, texts)]
                encoded = iter(tool.encode([piece for turn in turns for piece, control, _ in turn if not control]))
                positions, ids, masks = [], [], []
                for conversation, pieces in zip(conversations, turns):
                    if not started or conversation != current:
                        current, position, started = conversation, 0, True
                        pieces = [(BEGIN, True, False), *pieces]
                    tokens, mask = assemble(pieces, encoded, tool.reserved)
                    positions.append(position)
                    ids.append(tokens)
                    masks.append(mask)
                    position += len(tokens)
                columns = [
                    pa.array(conversations, pa.int64()),
                    pa.array(positions, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.int8())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=FORMATTED.names)

    return run


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Columns of ``FORMATTED``: a row per turn with its ids, their loss mask and the position of the first of them.

    ``conversations`` needs ``conv_id``, ``turn``, ``role``, ``text``. The rows of a
    conversation are in one partition, one behind the other.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(tokenizer_path), FORMATTED)


class _Reader:
    """Reads the ids of one conversation turn by turn and keeps running digests."""

    def __init__(self, tool: Codec):
        self.tool = tool
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> None:
        reserved = np.flatnonzero(ids >= self.tool.first_reserved)
        controls = [CONTROLS[ids[at] - self.tool.first_reserved] for at in reserved]
        self.formatted_chars += sum(map(len, controls))
        # Between two control ids there is a whole segment; an empty one has no ids.
        inner = [ids[a + 1 : b] for a, b in zip(reserved, reserved[1:])]
        masks = [mask[a + 1 : b] for a, b in zip(reserved, reserved[1:])]
        texts = [self.tool.decode(part) if len(part) else "" for part in inner]
        self.formatted_chars += sum(map(len, texts))
        at = 1 if controls[0] == BEGIN else 0
        if controls[at] in _OPENED:
            role, text = _OPENED[controls[at]], unescape(texts[at])
        else:
            role, text = unescape(texts[at]), unescape(texts[at + 1])
        self.turns += 1
        self.turn_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for part, covered in zip(texts, masks):
            if len(covered) and covered.all():
                trained = unescape(part)
                self.loss_chars += len(trained)
                self.loss_hash.update(trained.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.formatted_chars)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Columns of ``DIGESTS`` for each conversation of ``format_conversations``, from ids and mask alone.

    Reads a partition as a stream and holds one turn at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        current, reader = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=DIGESTS.names)

        for batch in batches:
            rows = []
            ids, masks = batch.column("ids"), batch.column("loss_mask")
            for at, conversation in enumerate(batch.column("conv_id").to_pylist()):
                if reader is None or conversation != current:
                    if reader is not None:
                        rows.append((current, *reader.row()))
                    current, reader = conversation, _Reader(tool)
                reader.read(ids[at].values.to_numpy(), masks[at].values.to_numpy())
            if rows:
                yield batch_of(rows)
        if reader is not None:
            yield batch_of([(current, *reader.row())])

    return formatted.mapInArrow(run, DIGESTS)
