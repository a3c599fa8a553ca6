"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every token has a row of a table of fixed size, by its hash, and every row a
sparse random index vector. The vector of a row is the sum of the index vectors
of its tokens' neighbours in all texts, labelled or not, scaled to length 1; a
row without neighbours keeps its index vector. So every token of every document
has a vector, however rare it is, and the table does not grow with the
corpus; tokens that share a row share a vector. A document is the mean of its
tokens' vectors with the tokens' shares per kind and length. A two-layer numpy
network turns that into a logit; a temperature fitted on rows the network was
not trained on calibrates the probability.

Tokens are lower-cased words, runs of marks, and signs for what the words do:
upper case, a repeated word, a line break. A batch of texts is cut, lower-cased
and hashed in flat arrays of characters. A word is told from the next by a 64-bit hash.

NULL and empty texts are the mean of no tokens, a zero vector, and get the score
of that. Labelled rows with a NULL label or id are not learned from; with labels
of one kind only, or none, every score is the share of label 1 (0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.bpe import flat_text, slices
from tripline.llm.common import bounded_labels

DIMENSIONS = 96
NONZERO = 6
REACH = 2
#: Labelled rows the network learns from.
MAX_LABELLED = 20_000
#: Rows of the table of vectors that tokens are hashed to.
ROWS = 1 << 16
HIDDEN = 32
THRESHOLD = 0.7
_PARTITIONS = 32
#: Bytes of text that are cut together.
_SLICE_BYTES = 1 << 20
#: Steps between 0 and 1 of a vector's numbers; vectors that are summed in single precision, and pairs counted together.
_STEPS, _SUMMED, _TOGETHER = 1 << 12, 1 << 12, 1 << 12

_LENGTHS = (3, 6, 10)
#: What a token can be: one of three signs, or of a kind and length.
SIGNS = ("<line>", "<upper>", "<same>")
LINE, UPPER, SAME = range(3)
KINDS = (*SIGNS, *(f"<{kind}{size}>" for kind in ("digits", "word", "marks") for size in range(4)))
_BLANK, _WORD, _LOW_LINE, _MARK, _NEW_LINE = range(5)
_CAPITAL, _SMALL, _NO_DIGIT = 1, 2, 4
#: Odd number whose powers weigh a token's code points in its hash.
_WEIGHT = 0x9E3779B97F4A7C15


def lower(letter: str) -> str:
    """Lower case of one character, where that is one character."""
    low = letter.lower()
    return low if len(low) == 1 else letter


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and flags of every code point.

    Letters and digits make words; runs of low lines and of other marks are tokens as well.
    """
    letters = list(map(chr, range(0x110000)))
    kinds = np.array([_WORD if c.isalnum() else _BLANK if c.isspace() else _MARK for c in letters], np.uint8)
    kinds[ord("_")], kinds[ord("\n")] = _LOW_LINE, _NEW_LINE
    lows = np.array([ord(lower(c)) for c in letters], np.uint32)
    flags = [_CAPITAL * c.isupper() | _SMALL * (c.islower() or c.istitle() and not c.isupper()) | _NO_DIGIT * (not c.isdigit()) for c in letters]
    return kinds, lows, np.array(flags, np.uint8)


def _rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of the table of vectors for hashes of lower-cased tokens."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return len(SIGNS) + ((mixed >> np.uint64(32)) % np.uint64(ROWS)).astype(np.int64)


def row_of(token: str) -> int:
    """Row of a lower-cased token."""
    total = sum((ord(c) + 1) * pow(_WEIGHT, at + 1, 1 << 64) for at, c in enumerate(token)) % (1 << 64)
    return int(_rows(np.array([total], np.uint64))[0])


@dataclass
class Cut:
    """Tokens of some texts: their rows and kinds, where each text's begin, and which texts they are."""

    texts: np.ndarray
    begins: np.ndarray
    rows: np.ndarray
    kinds: np.ndarray
    #: The first text goes on from the cut before.
    goes_on: bool


def cut(texts: pa.Array) -> Iterator[Cut]:
    """All tokens of all texts, with signs for upper case, repeated words and lines in front of the token they are about.

    A long text comes in parts, one after the other.
    """
    data, offsets = flat_text(texts)
    before, last = -1, None
    for part, of, begins in slices(data, offsets, _SLICE_BYTES):
        goes_on = len(of) == 1 and int(of[0]) == before
        found, last = _cut(part, begins, last if goes_on else None)
        yield Cut(of, *found, goes_on)
        before = int(of[-1])


def _cut(data: np.ndarray, begins: np.ndarray, last: int | None) -> tuple[tuple, int | None]:
    """Where each text's tokens begin, their rows and kinds; and the hash of the last word, which began as ``last``."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return (np.zeros(len(begins), np.int64), none, none), last
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    borders = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), begins)
    kinds, lows, flags = _characters()
    kind = kinds[points]
    first = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _NEW_LINE)))
    first[borders[:-1][np.diff(borders) > 0]] = True
    at = np.flatnonzero(first)
    length = np.diff(at, append=len(points))
    place = np.arange(len(points)) - np.repeat(at, length)
    weights = np.multiply.accumulate(np.full(int(length.max()), _WEIGHT, np.uint64))
    hashes = np.add.reduceat((lows[points].astype(np.uint64) + np.uint64(1)) * weights[place], at)
    flag = np.bitwise_or.reduceat(flags[points], at)

    kept = kind[at] != _BLANK
    at, length, hashes, flag, kind = at[kept], length[kept], hashes[kept], flag[kept], kind[at][kept]
    line, word = kind == _NEW_LINE, kind == _WORD
    text = np.searchsorted(borders, at, "right") - 1
    size = sum((length > limit).astype(np.int64) for limit in _LENGTHS)
    what = np.where(word, np.where(flag & _NO_DIGIT, 1, 0), 2)
    own_kind = np.where(line, LINE, len(SIGNS) + size + 4 * what)
    own_row = np.where(line, LINE, _rows(hashes))
    upper = (word & (length > 1) & ((flag & (_CAPITAL | _SMALL)) == _CAPITAL)).astype(np.int64)
    same, words = np.zeros(len(at), np.int64), np.flatnonzero(word)
    if len(words):
        value, of = hashes[words], text[words]
        same[words[1:]] = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
        same[words[0]] = last is not None and int(value[0]) == last
        last = int(value[-1])
    ends = np.cumsum(1 + upper + same)
    total = int(ends[-1]) if len(ends) else 0
    out_rows, out_kinds = np.full(total, UPPER), np.full(total, UPPER)
    out_rows[ends - 1], out_kinds[ends - 1] = own_row, own_kind
    repeated = ends[same > 0] - 2
    out_rows[repeated] = out_kinds[repeated] = SAME
    by_text = np.concatenate(([0], ends))[np.searchsorted(at, borders)]
    return (by_text, out_rows, out_kinds), last


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each row's sparse index vector is not zero, and the 1 or -1 there; the same everywhere."""
    state = np.random.default_rng(20)
    count = len(SIGNS) + ROWS
    places = np.argsort(state.random((count, DIMENSIONS), np.float32), axis=1, kind="stable")[:, :NONZERO]
    return places, state.choice((-1, 1), (count, NONZERO)).astype(np.int64)


class _Contexts:
    """Sums of neighbours' index vectors, by row."""

    def __init__(self):
        places, signs = index_vectors()
        self._places, self._signs = places, signs.astype(np.int32)
        # One task's pairs: far fewer than a 32-bit number holds.
        self.sums = np.zeros((len(places), DIMENSIONS), np.int32)
        self._tail = np.zeros(0, np.int64)

    def add(self, cut: Cut) -> None:
        """Pairs of tokens at most ``REACH`` apart in a text, with those of a part before it."""
        tail = self._tail if cut.goes_on else np.zeros(0, np.int64)
        found = np.concatenate((tail, cut.rows))
        text_of = np.concatenate((np.zeros(len(tail), np.int64), np.repeat(np.arange(len(cut.texts)), np.diff(cut.begins))))
        last = found[text_of == len(cut.texts) - 1]
        self._tail = last[-REACH:]
        flat, reach = self.sums.reshape(-1), len(tail)
        for start in range(0, len(found), _TOGETHER):
            some, of = found[start : start + _TOGETHER + REACH], text_of[start : start + _TOGETHER + REACH]
            places, signs, rows = self._places[some], self._signs[some], some[:, None] * DIMENSIONS
            for offset in range(1, REACH + 1):
                count = min(_TOGETHER, len(some) - offset)
                if count <= 0:
                    continue
                both = of[:count] == of[offset : offset + count]
                both[: max(reach - start - offset, 0)] = False
                left, right = slice(0, count), slice(offset, offset + count)
                for token, neighbour in ((left, right), (right, left)):
                    np.add.at(flat, (rows[token] + places[neighbour])[both].ravel(), signs[neighbour][both].ravel())


def learn_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all rows. A task sends one sum for each row that its texts use."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Contexts()
        for batch in batches:
            for one in cut(batch.column(0)):
                found.add(one)
        yield from _sums(np.flatnonzero(found.sums.any(axis=1)), found.sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(SIGNS) + ROWS, DIMENSIONS), np.int64)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[number] += _numbers(data)
        yield from _sums(np.flatnonzero(sums.any(axis=1)), sums)

    schema = "number long, sums binary"
    parts = texts.select("text").mapInArrow(contexts, schema)
    rows = parts.repartition(_PARTITIONS, "number").mapInArrow(added, schema).collect()  # at most one row per table row
    places, signs = index_vectors()
    vectors = np.zeros((len(places), DIMENSIONS))
    np.put_along_axis(vectors, places, signs, axis=1)
    for row in rows:
        vectors[row["number"]] = _numbers(row["sums"])
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (np.rint(vectors / np.where(lengths > 0, lengths, 1.0) * _STEPS) / _STEPS).astype(np.float32)


def _sums(rows: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One record per row, its numbers in the fewest bytes that hold them."""
    for start in range(0, len(rows), 4096):
        some = rows[start : start + 4096]
        most = np.abs(sums[some]).max(axis=1)
        spelled = [sums[row].astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes() for row, top in zip(some, most)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(spelled, pa.binary())], names=["number", "sums"])


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // DIMENSIONS}").astype(np.int64)


_FEATURES = DIMENSIONS + len(KINDS)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean vector of its tokens and the share of each kind."""
    out, counts = np.zeros((len(texts), _FEATURES)), np.zeros(len(texts), np.int64)
    for one in cut(texts):
        number = np.repeat(one.texts, np.diff(one.begins))
        shares = np.bincount(number * len(KINDS) + one.kinds, minlength=len(texts) * len(KINDS))
        out[:, DIMENSIONS:] += shares.reshape(len(texts), len(KINDS))
        counts += np.bincount(number, minlength=len(texts))
        # Sums of so many numbers with so many steps are exact, so a text's do not depend on what stands beside it.
        for start in range(0, len(number), _SUMMED):
            some = number[start : start + _SUMMED]
            first = np.flatnonzero(np.diff(some, prepend=-1))
            out[some[first], :DIMENSIONS] += np.add.reduceat(vectors[one.rows[start : start + _SUMMED]], first, axis=0)
    return out / np.maximum(counts, 1)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Network:
    """One hidden layer, one logit, and the temperature that calibrates it."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-3):
    """A network fitted with Adam to minimise the log loss; the same for the same rows."""
    state = np.random.default_rng(7)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - centre) / scale
    weights = [
        state.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        state.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = state.permutation(len(y))
        for start in range(0, len(y), batch):
            rows = order[start : start + batch]
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + decay * weights[0], back.sum(0), hidden.T @ error + decay * weights[2],
                      error.sum(keepdims=True)]
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, slope in enumerate(slopes):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope**2
                unbiased = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.999**step)
                weights[k] = weights[k] - pace * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-8)
    return Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def calibrated_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    losses = [np.logaddexp(0, np.where(y == 1, -logits, logits) / value).mean() for value in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass
class Model:
    """What scoring needs; ``network`` is None when there was nothing to tell apart."""

    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None or not len(texts):
            return np.full(len(texts), self.share)
        return self.network.probability(pooled(texts, self.vectors))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """Vectors are learned from all ``docs``, the network from about ``max_rows`` labelled ones at most.

    A fifth of those sets the temperature.
    """
    chosen = bounded_labels(labels, "quality", max_rows)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    vectors = learn_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # a table of fixed size

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row.tobytes() for row in pooled(batch.column(2), shared.value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "pooled"]
            )

    schema = T.StructType(
        [sample.schema["doc_id"], sample.schema["quality"], T.StructField("pooled", T.BinaryType())]
    )
    rows = sample.select("doc_id", "quality", "text").mapInArrow(pool, schema).toPandas()
    rows = rows.sort_values(["doc_id", "pooled"]).drop_duplicates("doc_id")
    y = (rows["quality"].to_numpy() == 1).astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(vectors, None, share)
    x = np.array([np.frombuffer(data, dtype=np.float64) for data in rows["pooled"]])
    checking = np.arange(len(y)) % 5 == 4
    if not checking.any():
        checking[:] = True
    network = train(x[~checking], y[~checking]) if (~checking).any() else train(x, y)
    network.temperature = calibrated_temperature(network.logits(x[checking]), y[checking])
    return Model(vectors, network, share)


def score(model: Model, spark, text: Column | str = "text") -> Column:
    """Probability of label 1 for each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(pa.array(texts, pa.string(), from_pandas=True)), dtype="float64")

    return probability(text)
