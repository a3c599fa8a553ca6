"""Byte-level BPE in batched numpy merge rounds, and back.

A batch of texts is one flat array of code points. Piece borders follow from
each character's class and its neighbours', so they are found for the whole
batch at once, and the distinct pieces among them are merged together: the
symbols of many pieces stand in one flat array, every round looks up the pairs
that changed by binary search over the sorted pair keys, and each piece merges
its lowest-ranked pair everywhere at once. Pieces that have no pair left drop
out. A piece is merged once per task while it is remembered.

Decoding looks up the bytes of each id and joins them; bytes that are not
UTF-8 become U+FFFD.

NULL and empty texts have no ids. Texts longer than a slice are cut in front
of a blank between two ASCII characters that are none, where a piece begins
anyway, so memory is bounded for any text that has such places.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE, NOTHING = range(5)
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 21
#: Pieces and bytes of pieces that a task remembers.
_REMEMBERED, _REMEMBERED_BYTES = 200_000, 1 << 25
_NO_RANK = np.iinfo(np.int32).max

# Code points with the property White_Space.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# A byte-level vocabulary writes printable bytes as themselves and the others from U+0100 on, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTER_OF_BYTE = {byte: chr(byte) for byte in _PRINTABLE} | {
    byte: chr(0x100 + n) for n, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)
}
_BYTE_OF_LETTER = {letter: byte for byte, letter in _LETTER_OF_BYTE.items()}
# English endings that are pieces of their own after an apostrophe.
_SHORT_ENDINGS = "stmd"
_LONG_ENDINGS = ("re", "ve", "ll")


@cache
def character_classes() -> np.ndarray:
    """Class of every code point.

    Characters that this Python does not know yet, but the newer ``regex``
    does, have the class that the installed tokenizer library cuts them by.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    kinds = {"L": LETTER, "N": NUMBER, "C": NOTHING}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    unsure = "".join(map(chr, np.flatnonzero(found == NOTHING)))
    found[found == NOTHING] = OTHER
    cutter = ByteLevel(add_prefix_space=False)
    for sample, kind, pattern in (("a", LETTER, r"\p{L}"), ("1", NUMBER, r"\p{N}")):
        for letter in regex.findall(pattern, unsure):
            if len(cutter.pre_tokenize_str(sample + letter)) == 1:
                found[ord(letter)] = kind
    found[_WHITE_SPACE] = SPACE
    return found


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for each code point that begins a piece; ``first`` is true where a segment begins.

    The pieces are those of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    applied to each segment.
    """
    kind = character_classes()[points]
    last = np.append(first[1:], True)
    before = np.where(first, NOTHING, np.concatenate(([NOTHING], kind[:-1])))
    after = np.where(last, NOTHING, np.append(kind[1:], NOTHING))
    behind_blank = ~first & np.concatenate(([False], points[:-1] == 0x20))
    # A run of white space gives its last character to what follows; a blank there begins the next piece.
    in_space = (before != SPACE) | ((after != SPACE) & (after != NOTHING))
    starts = np.where(kind == SPACE, in_space, (kind != before) & ~behind_blank)
    for at in np.flatnonzero((points == 0x27) & (before != OTHER) & ~behind_blank & (after == LETTER)):
        one = chr(points[at + 1])
        two = one + chr(points[at + 2]) if at + 2 < len(points) and not first[at + 2] else ""
        length = 1 if one in _SHORT_ENDINGS else 2 if two in _LONG_ENDINGS else 0
        if length:
            starts[at + 1] = False
            if at + 1 + length < len(points):
                starts[at + 1 + length] = True
    return starts


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins, with the end; NULL is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: their bytes, the rows they are of and where each begins, with the end.

    A text that is longer comes alone and in several parts, cut in front of a
    blank between two ASCII characters that are not white space.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1, row + 1)
        if offsets[end] - offsets[row] <= most:
            yield data[offsets[row] : offsets[end]], np.arange(row, end), offsets[row : end + 1] - offsets[row]
        else:
            at, stop = int(offsets[row]), int(offsets[end])
            while at < stop:
                cut = _cut(data, at, stop, most)
                yield data[at:cut], np.array([row]), np.array([0, cut - at])
                at = cut
        row = end


def _cut(data: np.ndarray, at: int, stop: int, most: int) -> int:
    """The last place to cut within ``most`` bytes of ``at``, else the first one behind them, else ``stop``."""
    begin, width = at + 1, most
    while begin + width < stop:
        part = data[begin - 1 : begin + width + 1]
        plain = (part > 0x20) & (part < 0x7F)
        places = np.flatnonzero((part[1:-1] == 0x20) & plain[:-2] & plain[2:])
        if len(places):
            return begin + int(places[-1] if begin == at + 1 else places[0])
        begin += width
    return stop


class ByteBpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` file.

    ``special=True`` finds added tokens in texts, as the library does by
    default; otherwise their strings are plain text. Files whose texts are
    normalised, whose pieces are cut in another way or that this class cannot
    follow for another reason are refused with ``ValueError``.
    """

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as file:
            self._load(json.load(file), special)
        self.forget()

    def _load(self, spec: dict, special: bool) -> None:
        model, cutter, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            spec["normalizer"]
            or cutter.get("type") != "ByteLevel"
            or cutter.get("add_prefix_space")
            or not cutter.get("use_regex", True)
            or model["type"] != "BPE"
            or any(model.get(name) for name in plain)
            or any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip"))
            or any(" " in token["content"] for token in added)
        ):
            raise ValueError("not a plain byte-level BPE tokenizer file")
        vocabulary = model["vocab"]
        self.size = 1 + max([*vocabulary.values(), *(token["id"] for token in added)])
        self._byte_ids = np.array([vocabulary[_LETTER_OF_BYTE[byte]] for byte in range(256)], np.int32)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self._merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        # A symbol made by a merge takes part in later ones only, so equal pairs of a piece can be merged together.
        made = np.full(self.size, -1, np.int64)
        np.maximum.at(made, self._merged, np.arange(len(pairs)))
        rank = np.arange(len(pairs))
        self._together = bool((made[left] < rank).all() and (made[right] < rank).all())
        contents = {token["content"]: token["id"] for token in added}
        self._added = sorted(contents.items(), key=lambda item: -len(item[0])) if special else []
        spelled = [b""] * self.size
        for token, number in vocabulary.items():
            spelled[number] = bytes(_BYTE_OF_LETTER[letter] for letter in token)
        for content, number in contents.items():
            spelled[number] = content.encode()
        self.spelled = pa.array(spelled, pa.large_binary())
        self.lengths = np.array(list(map(len, spelled)), np.int64)

    def forget(self) -> None:
        """Give back what the pieces seen so far take."""
        self._pieces: dict[bytes, int] = {}
        self._bytes = 0
        self._pool = np.zeros(0, np.int32)
        self._starts = np.zeros(0, np.int64)
        self._counts = np.zeros(0, np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        if not len(self._keys):
            return np.full(len(key), _NO_RANK, np.int32)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NO_RANK)

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: ``counts`` symbols of each stand one after the other. Returns ids and their counts."""
        word = np.flatnonzero(counts)
        counts = counts[word]
        total = int(word[-1]) + 1 if len(word) else 0
        ranks = np.full(len(symbols), _NO_RANK, np.int32)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(counts) - 1] = False
        at = np.flatnonzero(inner)
        ranks[at] = self._pair_ranks(symbols[at], symbols[at + 1])
        done_symbols, done_words = [], []
        while len(word):
            starts = np.cumsum(counts) - counts
            low = np.minimum.reduceat(ranks, starts)
            ended = low == _NO_RANK
            if ended.any():
                out = np.repeat(ended, counts)
                done_symbols.append(symbols[out])
                done_words.append(np.repeat(word[ended], counts[ended]))
                symbols, ranks = symbols[~out], ranks[~out]
                word, counts, low = word[~ended], counts[~ended], low[~ended]
                if not len(word):
                    break
                starts = np.cumsum(counts) - counts
            hit = np.flatnonzero(ranks == np.repeat(low, counts))
            if self._together:
                # Of pairs that overlap (runs of one symbol) every second one merges.
                begins = np.concatenate(([True], np.diff(hit) != 1))
                run = np.maximum.accumulate(np.where(begins, hit, 0))
                hit = hit[((hit - run) & 1) == 0]
            else:
                hit = hit[np.unique(np.searchsorted(starts, hit, "right"), return_index=True)[1]]
            symbols[hit] = self._merged[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            counts = np.add.reduceat(keep.astype(np.int64), starts)
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            symbols, ranks, changed = symbols[keep], ranks[keep], changed[keep]
            ends = np.cumsum(counts) - 1
            changed[:-1] |= changed[1:]
            changed[ends] = False
            ranks[ends] = _NO_RANK
            at = np.flatnonzero(changed)
            ranks[at] = self._pair_ranks(symbols[at], symbols[at + 1])
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(total, np.int64)
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(words, minlength=total)

    def _learn(self, new: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(new), np.uint8)
        ids, counts = self.merge(self._byte_ids[flat], np.array(list(map(len, new)), np.int64))
        ends = len(self._pool) + np.cumsum(counts)
        self._starts = np.concatenate((self._starts, ends - counts))
        self._counts = np.concatenate((self._counts, counts))
        self._pool = np.concatenate((self._pool, ids))
        self._bytes += len(flat)

    def _added_places(self, text: str, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, id) of each added token that lies in one segment."""
        import re

        if not any(content in text for content, _ in self._added):
            return []
        numbers = dict(self._added)
        pattern = re.compile("|".join(re.escape(content) for content, _ in self._added))
        found, bounds = [], [*np.flatnonzero(first).tolist(), len(text)]
        for begin, end in zip(bounds, bounds[1:]):
            found += [(m.start(), m.end(), numbers[m[0]]) for m in pattern.finditer(text, begin, end)]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments of UTF-8 bytes (``offsets`` says where each begins, with the end) and where each's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self._pieces) > _REMEMBERED or self._bytes > _REMEMBERED_BYTES:
            self.forget()
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        places = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(places, offsets[:-1][np.diff(offsets) > 0])] = True
        added = self._added_places(text, first)
        for begin, end, _ in added:
            first[begin] = True
            first[end : end + 1] = True
        starts = piece_starts(points, first)
        for begin, end, _ in added:
            starts[begin + 1 : end] = False
        borders = np.append(places[starts], len(data))
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data.tobytes())]
        ).dictionary_encode()
        distinct, known = pieces.dictionary.to_pylist(), len(self._pieces)
        ours = self._pieces
        at = np.fromiter((ours.setdefault(piece, len(ours)) for piece in distinct), np.int64, len(distinct))
        if len(ours) > known:
            self._learn([piece for piece, number in zip(distinct, at) if number >= known])
        at = at[pieces.indices.to_numpy()]
        begins, counts = self._starts[at], self._counts[at]
        pool = self._pool
        if added:
            index = np.searchsorted(borders, places[[begin for begin, _, _ in added]])
            begins[index], counts[index] = len(pool) + np.arange(len(added)), 1
            pool = np.concatenate((pool, np.array([number for _, _, number in added], np.int32)))
        ends = np.cumsum(counts)
        ids = pool[np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(borders, offsets)]

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, where each row's ids begin) of slices of the texts; a long text's parts come one after the other."""
        data, offsets = flat_text(texts)
        for part, rows, begins in slices(data, offsets, SLICE_BYTES):
            yield (rows, *self.encode(part, begins))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        joined = self.spelled.take(pa.array(ids))
        _, begins, data = joined.buffers()
        begins = np.frombuffer(begins, np.int64)[offsets]
        whole = memoryview(data) if data is not None else b""
        return [bytes(whole[a:b]) for a, b in zip(begins, begins[1:])]


def as_text(joined: bytes) -> str:
    """Text of decoded bytes; what is not UTF-8 becomes U+FFFD."""
    return joined.decode("utf-8", "replace")


_LOADED: dict[tuple[str, bool], ByteBpe] = {}


def loaded(path: str, special: bool = True) -> ByteBpe:
    """The tokenizer of this Python worker."""
    if (path, special) not in _LOADED:
        _LOADED[path, special] = ByteBpe(path, special)
    return _LOADED[path, special]


def encode_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for each row of ``docs``; no other column is read. NULL texts have no ids."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for rows, ids, begins in bpe.encode_texts(batch.column(1)):
                for row, a, b in zip(rows, begins, begins[1:]):
                    found[row].append(ids[a:b])
            joined = [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in found]
            yield pa.record_batch([batch.column(0), pa.array(joined, pa.list_(pa.int32()))], ["doc_id", "ids"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(job, f"doc_id {id_type}, ids array<int>")


def decode_documents(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id`` and ``text`` for rows of ``doc_id`` and ``ids``; NULL ids give an empty text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            texts = [as_text(bpe.decode(np.array(ids or [], np.int32), np.array([0, len(ids or [])]))[0])
                     for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(job, f"doc_id {id_type}, text string")


class _Digest:
    """Running digests of a document whose ids come in parts."""

    def __init__(self):
        self.count, self.ids, self.text, self._rest = 0, hashlib.sha256(), hashlib.sha256(), b""

    def add(self, count: int, decimal: bytes, joined: bytes) -> None:
        if count:
            self.ids.update(b"," + decimal if self.count else decimal)
            self.count += count
            self._add_text(joined)

    def _add_text(self, joined: bytes) -> None:
        """Parts end in front of a blank, so no character spans two of them."""
        try:
            joined.decode("utf-8")
        except UnicodeDecodeError:
            joined = as_text(joined).encode("utf-8")
        self.text.update(joined)

    def row(self) -> tuple[int, str, str]:
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


def digests(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The first digest is that of the decimal ids joined by commas, the second
    that of the decoded text in UTF-8. NULL texts are empty; a NULL or
    repeated id is kept with its row; no other column is read.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        decimal = pa.array([b"%d," % number for number in range(bpe.size)], pa.large_binary())
        for batch in batches:
            found = [_Digest() for _ in range(batch.num_rows)]
            for rows, ids, begins in bpe.encode_texts(batch.column(1)):
                written = decimal.take(pa.array(ids))
                _, at, data = written.buffers()
                at = np.frombuffer(at, np.int64)[begins]
                whole = memoryview(data) if data is not None else b""
                for row, joined, count, a, b in zip(rows, bpe.decode(ids, begins), np.diff(begins), at, at[1:]):
                    found[row].add(int(count), bytes(whole[a : b - 1]) if count else b"", joined)
            counts, of_ids, of_text = zip(*(digest.row() for digest in found)) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(job, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
