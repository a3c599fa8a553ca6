"""Token ids of a corpus in a binary file format, in ascending order of document ids.

``write`` sorts the documents into ranges of ids, encodes them once, counts
all ids for one shared table, and codes runs of whole documents into rANS
blocks (``rans``). A block is decoded without any other; a row of the dataset
``blocks`` holds one with its place, and ``table`` holds the shared table.
``read`` checks and decodes the blocks in parallel.

A text is encoded by its distinct pieces between ASCII white space, each of
them once per task: the tokenizer drops white space and never joins across it.
NULL texts are empty and, like empty ones, still get the end id. Documents with
a NULL id come first. Repeated ids are all written, in an order that depends
on their texts only.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm import rans
from tripline.operators.workdir import WorkDir

END_ID = 1
#: A block closes with the document that brings it to this many ids.
BLOCK_IDS = 1 << 20
#: Characters that are encoded together.
_SLICE_CHARS = 1 << 22
#: Words that a task remembers.
_REMEMBERED = 500_000
#: Pieces that are Python objects at a time.
_MERGED_PIECES = 1 << 13
#: Words whose ids are put together at a time.
_ASSEMBLED_WORDS = 1 << 16
#: Latin letters whose lower case and composed form do not depend on what stands around them, then ASCII marks.
_LETTERS_AND_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


# A byte-level vocabulary writes printable bytes as themselves and the others from U+0100 on, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {byte: chr(0x100 + n) for n, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}


# How the tokenizer file that words can be encoded apart for prepares text and cuts it.
_PREPARED = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


# The letter of each byte; the line feed between pieces stays.
_LETTER_OF = np.array([ord(_BYTE_LETTERS.get(byte, chr(byte))) for byte in range(256)], dtype="<u4")
_LETTER_OF[ord("\n")] = ord("\n")


def _byte_letters(pieces: list[str]) -> list[str]:
    """Pieces, none of which has a line feed, as a byte-level vocabulary writes them."""
    joined = np.frombuffer("\n".join(pieces).encode("utf-8"), dtype=np.uint8)
    return _LETTER_OF[joined].tobytes().decode("utf-32-le").split("\n") if pieces else []


class _Runs:
    """Numbered strings and the ids each of them stands for."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.string())
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def __len__(self) -> int:
        return len(self.names)

    def numbers(self, names: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of different names; ``learn`` gives how many ids each new one has, and these ids."""
        found = pc.index_in(names, value_set=self.names)
        new = names.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            at[at < 0] = len(self) + np.arange(len(new))
            lengths, ids = learn(new)
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.pool = np.concatenate((self.pool, ids))
            self.names = pa.concat_arrays([self.names, new])
        return at

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some numbers has, and the ids of all of them in this order."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return lengths, self.pool[places]


class WordEncoder:
    """Encodes texts word by word, each distinct piece of a word once while it is remembered.

    A word of Latin letters with marks behind it is two pieces, its lower-cased
    letters and its marks, because the tokenizer lowers case and parts letters
    from marks; any other word is one piece.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Only these parts: the whole file as Python objects takes several times as much memory as the tokenizer.
        parts = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        spec = tuple(part and json.loads(part.__getstate__()) for part in parts)
        #: The short way holds for files that prepare text and cut pieces in this way; others encode whole texts.
        self.by_words = spec == (_PREPARED, _CUT) and not self.tokenizer.truncation
        self.forget()

    def forget(self) -> None:
        """Give back what the words seen so far take."""
        self._words, self._pieces = _Runs(), _Runs()
        pa.default_memory_pool().release_unused()

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words by their pieces. No piece has a blank, so one in front tells words that are a piece as they are."""
        found = pc.extract_regex(words, _LETTERS_AND_MARKS)
        whole = pc.binary_join_element_wise("", words, " ")
        first = pc.if_else(found.is_null(), whole, pc.utf8_lower(pc.struct_field(found, "letters")))
        # NULL where a word is no letters and marks; without marks an empty piece, which has no ids.
        marks = pc.struct_field(found, "marks").fill_null("")
        coded = pa.concat_arrays([first, marks]).dictionary_encode()
        at = self._pieces.numbers(coded.dictionary, self._learn_pieces)[coded.indices.to_numpy()]
        lengths, ids = self._pieces.ids(at.reshape(2, -1).T.ravel())
        return lengths.reshape(-1, 2).sum(axis=1), ids

    def _learn_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, of some at a time: as Python objects they take many times as much memory."""
        parts = [self._merged(new[at : at + _MERGED_PIECES].to_pylist()) for at in range(0, len(new), _MERGED_PIECES)]
        return np.concatenate([lengths for lengths, _ in parts]), np.concatenate([ids for _, ids in parts])

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters and marks need the merges only, other pieces the whole tokenizer."""
        merge, whole = self.tokenizer.model.tokenize, self.tokenizer.encode
        found: list[list[int]] = [[] for _ in pieces]
        other = [at for at, piece in enumerate(pieces) if not piece.isascii() and piece[0] != " "]
        for at, letters in zip(other, _byte_letters([pieces[at] for at in other])):
            pieces[at] = letters
        for at, piece in enumerate(pieces):
            if piece[:1] == " ":
                found[at] = whole(piece[1:], add_special_tokens=False).ids
            elif piece:
                found[at] = [token.id for token in merge(piece)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(chain.from_iterable(found), np.uint32, lengths.sum())

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        if not len(texts):
            return []
        if not self.by_words:
            whole = self.tokenizer.encode_batch([text or "" for text in texts.to_pylist()], add_special_tokens=False)
            return [np.array(one.ids, dtype=np.uint32) for one in whole]
        if len(self._words) > _REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        at = self._words.numbers(coded.dictionary, self._learn_words)
        indices = coded.indices.to_numpy()
        found: list[np.ndarray] = []
        # The ids of some texts at a time: their places take several times as much memory.
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + _ASSEMBLED_WORDS, side="right")))
            lengths, ids = self._words.ids(at[indices[before : ends[last - 1]]])
            by_word = np.concatenate(([0], np.cumsum(lengths)))
            found += np.split(ids, by_word[ends[first : last - 1] - before])
            first = last
        return found


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """The encoder of this process."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ids):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + _SLICE_CHARS, side="right")))
            yield ids[start:end], texts[start:end]
            start = end


_RAW = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _raw_blocks(tokenizer_path: str, end_id: int, block_ids: int):
    """Groups the sorted documents of a partition into blocks of raw ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        block, start, doc_ids, pieces, lengths, size = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            data = np.concatenate(pieces).astype("<u4")
            narrow = data.astype("<u2") if not len(data) or data.max() < 1 << 16 else data
            values = [[part], [block], [start], [size], [doc_ids], [lengths], [narrow.tobytes()]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(value, kind) for value, kind in zip(values, types)], names=_RAW.names
            )

        for ids, texts in _slices(batches):
            for doc_id, found in zip(ids, tool.encode(texts)):
                doc_ids.append(doc_id)
                pieces.append(np.append(found, np.uint32(end_id)))
                lengths.append(len(found) + 1)
                size += len(found) + 1
                if size >= block_ids:
                    yield closed()
                    block, start, doc_ids, pieces, lengths, size = block + 1, start + size, [], [], [], 0
        tool.forget()
        if doc_ids:
            yield closed()

    return run


def _ids_of(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype(np.uint32)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for count, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.bincount(_ids_of(data, count))
            if len(found) > len(totals):
                totals = np.concatenate((totals, np.zeros(len(found) - len(totals), dtype=np.int64)))
            totals[: len(found)] += found
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], names=["id", "n"])


@dataclass(frozen=True)
class TokenFiles:
    """Where the dataset is."""

    blocks: str
    table: str


def _load_table(spark: SparkSession, path: str) -> rans.Table:
    # At most one row per id of the vocabulary.
    rows = spark.read.parquet(path).toPandas().sort_values("id")
    return rans.Table(rows["id"].to_numpy(dtype=np.int64), rows["frequency"].to_numpy(dtype=np.int64))


def write(
    docs: DataFrame, path: str, work: WorkDir, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> TokenFiles:
    """Write the ids of ``docs`` (``doc_id``, ``text``) under ``path``; other columns are not read."""
    spark = docs.sparkSession
    files = TokenFiles(f"{path}/blocks", f"{path}/table")
    # The last two keys only spread rows that repeat an id over several ranges.
    dealt = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.xxhash64("text").alias("tie"),
            F.rand(END_ID).alias("spread"),
        )
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie", "spread")
        .sortWithinPartitions("doc_id", "tie", "spread")
        .select("doc_id", "text")
    )
    raw = work.store(dealt.mapInArrow(_raw_blocks(tokenizer_path, end_id, block_ids), _RAW), "raw")
    counts = raw.select("n_ids", "ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    table = rans.Table.from_counts(found["id"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64))
    rows = list(zip(table.ids.tolist(), table.frequencies.astype(np.int64).tolist()))
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(files.table)
    shared = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                data = rans.encode(_ids_of(row["ids"], row["n_ids"]), np.array(row["lengths"]), shared.value)
                kept = [pa.array([row[name]], batch.schema.field(name).type) for name in _RAW.names[:5]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([data], pa.binary())], names=[*_RAW.names[:5], "data"])

    schema = T.StructType([*_RAW.fields[:5], T.StructField("data", T.BinaryType())])
    raw.mapInArrow(code, schema).write.parquet(files.blocks)
    work.drop(raw)
    return files


_READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _decoded(spark: SparkSession, files: TokenFiles, schema: T.StructType, row):
    """Decodes all blocks; ``row(doc_id, start, ids)`` gives the values of one document."""
    shared = spark.sparkContext.broadcast(_load_table(spark, files.table))
    blocks = spark.read.parquet(files.blocks)
    # One number per range of ids: how many ids stand before it.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for size in sizes:
        before[size["part"]] = total
        total += size["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = rans.Decoder(shared.value)
        for batch in batches:
            for number in range(batch.num_rows):
                block = batch.slice(number, 1).to_pylist()[0]
                found = decoder.decode(block["data"])
                ends = np.cumsum(found.lengths, dtype=np.int64)
                first = before[block["part"]] + block["start_in_part"]
                rows = [
                    row(doc_id, first + int(end) - int(length), found.ids[int(end) - int(length) : int(end)])
                    for doc_id, length, end in zip(block["doc_ids"], found.lengths, ends)
                ]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(field.dataType) for field in schema.fields]
    return blocks.select("part", "start_in_part", "doc_ids", "data").mapInArrow(decode, schema)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start`` (ids before it) and ``ids`` (u32, little-endian)."""
    return _decoded(spark, files, _READ, lambda doc_id, start, ids: (doc_id, start, ids.astype("<u4").tobytes()))


_DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its ids."""
    return _decoded(
        spark,
        files,
        _DIGEST,
        lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
    )
