"""Aligning the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the token of the
other tokenizer that overlaps it farthest to the right; a token of the first
one that ends together with it points to itself. Pointers never lead back, so
replacing each by its pointer's pointer doubles their reach, and after a
logarithmic number of rounds all tokens of a connected component point to its
last token. Those labels are the groups. All tokens of a batch of texts stand in flat
arrays, because no component crosses the end of a text.

Corpus-wide counts of id pairs need every document's pairs twice, first to
count and then to look the counts up. Documents are aligned once and stored in
blocks of bounded size: a block holds its distinct pairs and, packed, how often each
document has them. Only a block's distinct pairs are shuffled, to be counted
and back to their block, never a document's links; the count of a pair that is
everywhere is summed from one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.bpe import ByteBpe, flat_text, slices
from tripline.operators.workdir import WorkDir

#: A block closes with the document that brings it to so many links or documents.
BLOCK_LINKS, BLOCK_DOCUMENTS = 1 << 20, 1 << 13
#: Bytes of text that are aligned together, and of words that a task remembers.
SLICE_BYTES, _REMEMBERED_BYTES = 1 << 20, 1 << 25
_REMEMBERED = 200_000
_MARK = "▁"


class PieceBpe:
    """A sentencepiece BPE model that neither normalises nor joins across blanks; each word is encoded once per task.

    A word is a run of blanks with what follows it. The model puts a blank in
    front, which stands for the word's first one. Other models are refused
    with ``ValueError``.
    """

    def __init__(self, path: str):
        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        probe = "a  b \n\tﬁｱÅ"
        if any(_MARK in piece.lstrip(_MARK) for piece in pieces) or model.decode(model.encode(probe)) != probe:
            raise ValueError("not a plain sentencepiece BPE model")
        self.size = len(pieces)
        spelled = [
            bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace(_MARK, " ").encode()
            for n, piece in enumerate(pieces)
        ]
        self.spelled, self._blank = spelled, model.piece_to_id(_MARK)
        self.lengths = np.array(list(map(len, spelled)), np.int64)
        self.forget()

    def forget(self) -> None:
        self._words: dict[bytes, int] = {}
        self._bytes = 0
        self._pool = np.zeros(0, np.int32)
        self._starts = np.zeros(0, np.int64)
        self._counts = np.zeros(0, np.int64)
        self._same = np.zeros(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        found = self._model.encode([word[1:].decode("utf-8") for word in new], num_threads=1)
        found = [ids if word != b" " else [self._blank] for ids, word in zip(found, new)]
        counts = np.array(list(map(len, found)), np.int64)
        flat = np.fromiter((number for ids in found for number in ids), np.int32, counts.sum())
        ends = len(self._pool) + np.cumsum(counts)
        same = [b"".join(map(self.spelled.__getitem__, ids)) == word for ids, word in zip(found, new)]
        self._starts = np.concatenate((self._starts, ends - counts))
        self._counts = np.concatenate((self._counts, counts))
        self._pool = np.concatenate((self._pool, flat))
        self._same = np.concatenate((self._same, np.array(same, bool)))
        self._bytes += sum(map(len, new))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments that begin with a blank or are empty, where each's begin, and whether they spell its bytes."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.ones(len(offsets) - 1, bool)
        if len(self._words) > _REMEMBERED or self._bytes > _REMEMBERED_BYTES:
            self.forget()
        blank = data == 0x20
        begins = blank & ~np.concatenate(([False], blank[:-1]))
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        borders = np.append(np.flatnonzero(begins), len(data))
        words = pa.Array.from_buffers(
            pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data.tobytes())]
        ).dictionary_encode()
        distinct, ours, known = words.dictionary.to_pylist(), self._words, len(self._words)
        at = np.fromiter((ours.setdefault(word, len(ours)) for word in distinct), np.int64, len(distinct))
        if len(ours) > known:
            self._learn([word for word, number in zip(distinct, at) if number >= known])
        at = at[words.indices.to_numpy()]
        counts = self._counts[at]
        ends = np.cumsum(counts)
        ids = self._pool[np.repeat(self._starts[at] - (ends - counts), counts) + np.arange(ends[-1])]
        border = np.searchsorted(borders, offsets)
        wrong = np.concatenate(([0], np.cumsum(~self._same[at])))[border]
        return ids, np.concatenate(([0], ends))[border], np.diff(wrong) == 0


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def group_labels(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 on in order, of the tokens of two cuts of the same bytes."""
    (start_a, end_a), (start_b, end_b) = _ends(lengths_a), _ends(lengths_b)
    count = len(lengths_a)
    last_b = np.searchsorted(start_b, end_a, "left") - 1
    last_a = np.searchsorted(start_a, end_b, "left") - 1
    pointer = np.concatenate((np.where(end_b[last_b] > end_a, count + last_b, np.arange(count)), last_a))
    while True:
        farther = pointer[pointer]
        if (farther == pointer).all():
            break
        pointer = farther
    number = np.cumsum(pointer[:count] == np.arange(count)) - 1
    return number[pointer[:count]], number[pointer[count:]]


def overlaps(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens whose bytes overlap, by the first tokenizer's position."""
    (start_a, end_a), (start_b, end_b) = _ends(lengths_a), _ends(lengths_b)
    first = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - first
    ends = np.cumsum(count)
    at = np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lengths_a)), count), np.repeat(first - (ends - count), count) + at


class Aligner:
    """Both tokenizers and what is worked out for each text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a, special=False), PieceBpe(path_b)
        self.bits_b = max(self.b.size - 1, 1).bit_length()
        self.bits = max(self.a.size - 1, 1).bit_length() + self.bits_b
        written = [b"%d%c" % (n, mark) for n in range(self.a.size) for mark in b",|"]
        written += [b"%d%c" % (n, mark) for n in range(self.b.size) for mark in b",;"]
        self._written = pa.array(written, pa.large_binary())

    def _slice(self, part: np.ndarray, begins: np.ndarray) -> Iterator[tuple | None]:
        """For each segment: (n_a, n_b, n_groups, n_links, pairs, their times, groups as text); None if it cannot be aligned."""
        ids_a, at_a = self.a.encode(part, begins)
        ids_b, at_b, same = self.b.encode(part, begins)
        count_a, count_b = np.where(same, np.diff(at_a), 0), np.where(same, np.diff(at_b), 0)
        ids_a, ids_b = ids_a[np.repeat(same, np.diff(at_a))], ids_b[np.repeat(same, np.diff(at_b))]
        if not len(ids_a):
            yield from ((0, 0, 0, 0, *[np.zeros(0, np.int64)] * 2, b"") if ok else None for ok in same)
            return
        at_a, at_b = np.concatenate(([0], np.cumsum(count_a))), np.concatenate(([0], np.cumsum(count_b)))
        group_a, group_b = group_labels(self.a.lengths[ids_a], self.b.lengths[ids_b])
        in_a, in_b = overlaps(self.a.lengths[ids_a], self.b.lengths[ids_b])
        segment = np.repeat(np.arange(len(same)), count_a)[in_a]
        pair = (ids_a[in_a].astype(np.int64) << self.bits_b) | ids_b[in_b]
        keys, times = np.unique((segment << self.bits) | pair, return_counts=True)
        at_keys = np.searchsorted(keys, np.arange(len(same) + 1) << self.bits)
        pairs = keys & ((1 << self.bits) - 1)
        links = np.searchsorted(segment, np.arange(len(same) + 1))
        groups = np.searchsorted(group_a, np.arange(group_a[-1] + 2))
        groups = np.searchsorted(groups[:-1], at_a)
        # A group's tokens of the first tokenizer stand before its tokens of the second.
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = 2 * ids_a + np.append(np.diff(group_a) > 0, True)
        order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = (
            2 * self.a.size + 2 * ids_b + np.append(np.diff(group_b) > 0, True)
        )
        text = self._written.take(pa.array(order))
        _, at_text, data = text.buffers()
        at_text, whole = np.frombuffer(at_text, np.int64)[at_a + at_b], memoryview(data)
        for n, ok in enumerate(same):
            if not ok:
                yield None
                continue
            keyed = slice(at_keys[n], at_keys[n + 1])
            yield (
                int(count_a[n]), int(count_b[n]), int(groups[n + 1] - groups[n]), int(links[n + 1] - links[n]),
                pairs[keyed], times[keyed], bytes(whole[at_text[n] : max(at_text[n + 1] - 1, at_text[n])]),
            )

    def align(self, texts: pa.Array) -> Iterator[tuple[int, tuple | None]]:
        """(row, figures of a part of its text); the parts of a long text come one after the other."""
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), spaced)
        data, offsets = flat_text(spaced)
        for part, rows, begins in slices(data, offsets, SLICE_BYTES):
            yield from zip(rows.tolist(), self._slice(part, begins))


class _Document:
    """What a document's parts add up to."""

    def __init__(self):
        self.figures, self.pairs, self.times, self.digest, self.whole = [0, 0, 0, 0], [], [], None, True

    def add(self, part: tuple | None) -> None:
        if part is None:
            self.whole = False
        elif part[0]:
            self.figures = [a + b for a, b in zip(self.figures, part)]
            self.pairs.append(part[4])
            self.times.append(part[5])
            if self.digest is None:
                self.digest = hashlib.sha256(part[6])
            else:
                self.digest.update(b";" + part[6])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.whole or not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            return self.pairs[0], self.times[0]
        pairs, where = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, where, np.concatenate(self.times))
        return pairs, times

    def row(self) -> tuple:
        if not self.whole or self.digest is None:
            return 0, 0, 0, 0, ""
        return *self.figures, self.digest.hexdigest()


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * count, "zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _block(number: int, ids: list[pa.Scalar], documents: list[_Document], id_type: pa.DataType) -> pa.RecordBatch:
    entries = [document.entries() for document in documents]
    counts = np.array([len(pairs) for pairs, _ in entries], np.int64)
    pairs, where = np.unique(np.concatenate([pairs for pairs, _ in entries]), return_inverse=True)
    times = np.concatenate([times for _, times in entries])
    steps = np.diff(where, prepend=0)
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    steps[firsts] = where[firsts]
    *figures, digests = zip(*(document.row() for document in documents))
    held = np.bincount(where, minlength=len(pairs))
    listed = lambda values, kind: pa.array([values], pa.list_(kind))
    columns = {
        "block": pa.array([number], pa.int64()),
        "ids": pa.array([[one.as_py() for one in ids]], pa.list_(id_type)),
        **{name: listed(list(values), pa.int64()) for name, values in zip(_FIGURES, figures)},
        "digests": listed(list(digests), pa.string()),
        "pairs": listed(pairs, pa.int64()),
        "documents": listed(held, pa.int64()),
        "counts": listed(counts, pa.int64()),
        "steps": pa.array([_pack(steps)], pa.binary()),
        "times": pa.array([_pack(times)], pa.binary()),
    }
    return pa.record_batch(list(columns.values()), list(columns))


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` has the columns id and text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, task = _aligner(path_a, path_b), 0, TaskContext.get().partitionId()
        ids, documents, links = [], [], 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            found = [_Document() for _ in range(batch.num_rows)]
            for row, part in aligner.align(batch.column(1)):
                found[row].add(part)
            for one, document in zip(batch.column(0), found):
                ids.append(one)
                documents.append(document)
                links += document.figures[3]
                if links >= BLOCK_LINKS or len(ids) >= BLOCK_DOCUMENTS:
                    yield _block(task << 32 | number, ids, documents, id_type)
                    ids, documents, links, number = [], [], 0, number + 1
        if ids:
            yield _block(task << 32 | number, ids, documents, id_type)

    id_name = docs.schema[0].dataType.simpleString()
    figures = ", ".join(f"{name} array<long>" for name in _FIGURES)
    return docs.mapInArrow(
        job,
        f"block long, ids array<{id_name}>, {figures}, digests array<string>, pairs array<long>, documents array<long>, "
        "counts array<long>, steps binary, times binary",
    )


def _documents_of(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one block; ``counted`` has the corpus-wide figures of its pairs."""
    block = blocks.slice(0, 1)
    values = lambda name: block[name].combine_chunks().flatten()
    counts = values("counts").to_numpy()
    total = int(counts.sum())
    ends = np.cumsum(counts)
    order = np.argsort(counted["pair"].to_numpy(), kind="stable")
    in_corpus, best = counted["total"].to_numpy()[order], counted["best"].to_numpy()[order]
    steps, times = (_unpack(block[name][0].as_py(), total) for name in ("steps", "times"))
    # Steps add up to positions within a document.
    run = np.cumsum(steps)
    before = np.concatenate(([0], run))[ends - counts]
    where = run - np.repeat(before, counts)
    add_up = lambda numbers: np.diff(np.concatenate(([0], np.cumsum(numbers)))[np.concatenate(([0], ends))])
    columns = {
        "doc_id": values("ids"),
        **{name: values(name) for name in _FIGURES},
        "n_best": pa.array(add_up(times * best[where]), pa.int64()),
        "count_sum": pa.array(add_up(times * in_corpus[where]), pa.int64()),
        "groups_sha256": values("digests"),
    }
    return pa.table(columns)


def align(
    docs: DataFrame, work: WorkDir, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Figures of the alignment of each row's text: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    ``tokenizer_a`` is a byte-level BPE file, which gets a blank and the text,
    ``tokenizer_b`` a sentencepiece BPE model, which adds the blank itself;
    strings of special tokens are plain text. Texts that are NULL, empty or
    not spelled by the second tokenizer's pieces (they hold U+2581) have no tokens: zeros and an
    empty digest. A pair of ids counts once for each row of ``docs`` that links it,
    so repeated rows count as often as they stand there. NULL ids are kept; no
    other column is read; an empty table gives an empty result.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = work.store(_blocks(chosen, tokenizer_a, tokenizer_b), "blocks")
    held = blocks.select(F.col("block").alias("of_block"), F.explode(F.arrays_zip("pairs", "documents")).alias("held"))
    held = held.select("of_block", F.col("held.pairs").alias("pair"), F.col("held.documents").alias("documents"))
    totals = work.store(held.groupBy("pair").agg(F.sum("documents").alias("total")), "totals")
    first = F.shiftright("pair", max(sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size() - 1, 1).bit_length())
    highest = totals.groupBy(first.alias("first")).agg(F.max("total").alias("highest"))
    scored = totals.join(highest, first == F.col("first")).select(
        F.col("pair").alias("scored_pair"), "total", (F.col("total") == F.col("highest")).cast("long").alias("best")
    )
    scored = work.store(scored, "scored")
    counted = held.join(scored, F.col("pair") == F.col("scored_pair")).select("of_block", "pair", "total", "best")
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_documents_of, schema)


def aligned_groups(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id`` and ``groups``, each row's groups as ``a1,a2|b1;a3|b2,b3`` in decimal ids; empty without tokens."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            parts: list[list[bytes] | None] = [[] for _ in range(batch.num_rows)]
            for row, part in aligner.align(batch.column(1)):
                if part is None:
                    parts[row] = None
                elif parts[row] is not None and part[0]:
                    parts[row].append(part[6])
            texts = pa.array([b";".join(found or []).decode() for found in parts], pa.string())
            yield pa.record_batch([batch.column(0), texts], ["doc_id", "groups"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(job, f"doc_id {id_type}, groups string")
