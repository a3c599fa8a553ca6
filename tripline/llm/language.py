"""Language identification with rank-order profiles.

A profile lists the most frequent 1-, 2- and 3-grams of a language in order.
A document's own most frequent n-grams are compared to each profile by the
out-of-place distance: how far each n-gram is from its rank there, or the
largest distance where the profile lacks it. The language with the smallest
distance wins; ties go to the language that sorts first.

N-grams are taken from the letters of the lower-cased text; anything else is a
word boundary, which counts as one blank at either end of a word. Profiles
are counted over all training documents. A text that is NULL or has no letter
is ``und`` with score 0. A score is the share of the runner-up's distance in the
sum of the two smallest distances, 0.5 when they tie; with one language it is
the share of the distance that is not used up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: N-grams in a profile, of a language and of a document.
PROFILE_SIZE = 400
_CHAR_BITS = 21
#: Parts a language's n-grams are dealt to while the most frequent are picked.
_PARTS = 16
_CHUNK = 1 << 20
_BLANK = ord(" ")

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter; made once per process."""
    if not _LETTERS:
        table = np.fromiter((chr(code).isalpha() for code in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _LETTERS.append(table)
    return _LETTERS[0]


def _chunk_codes(codes: np.ndarray) -> np.ndarray:
    """Packed n-grams of letters (code points, blanks between words and at both ends)."""
    padded = codes.astype(np.uint64)
    first, second, third = padded, padded[1:], padded[2:]
    letters = padded != _BLANK
    one = first[letters]
    two = (first[:-1] | (second << np.uint64(_CHAR_BITS)))[letters[:-1] | letters[1:]]
    three = (first[:-2] | (second[:-1] << np.uint64(_CHAR_BITS)) | (third << np.uint64(2 * _CHAR_BITS)))[letters[1:-1]]
    return np.concatenate((one, two, three))


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a whole text, ascending, and how often each occurs."""
    nothing = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if not text:
        return nothing
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _is_letter()[codes]
    if not letters.any():
        return nothing
    # A blank where a word ends, all other separators dropped, and one at either end.
    spaced = np.where(letters, codes, _BLANK)
    keep = letters | np.concatenate(([False], letters[:-1]))
    spaced = np.concatenate(([_BLANK], spaced[keep], [_BLANK] if letters[-1] else []))
    # Long texts are counted in chunks that overlap by two, so no n-gram is lost or counted twice.
    if len(spaced) <= _CHUNK:
        return np.unique(_chunk_codes(spaced), return_counts=True)
    totals: dict[int, int] = {}
    words = np.flatnonzero(spaced == _BLANK)
    start = 0
    while start < len(spaced) - 1:
        reach = words[words <= start + _CHUNK]
        end = int(reach[-1]) if len(reach) and reach[-1] > start else int(words[words > start][0])
        for code, count in zip(*np.unique(_chunk_codes(spaced[start : end + 1]), return_counts=True)):
            totals[int(code)] = totals.get(int(code), 0) + int(count)
        start = end
    keys = np.array(sorted(totals), dtype=np.uint64)
    return keys, np.array([totals[int(key)] for key in keys], dtype=np.int64)


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; equal counts by code."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram totals of each language in one partition."""
    pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, index = np.unique(np.concatenate([part[0] for part in parts]), return_inverse=True)
        return grams, np.bincount(index, np.concatenate([part[1] for part in parts])).astype(np.int64)

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = pending.setdefault(language, [])
            parts.append(ngram_counts(text))
            if len(parts) >= 256:
                pending[language] = [merged(parts)]
    for language, parts in pending.items():
        grams, counts = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)],
            names=["lang", "gram", "n"],
        )


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profiled n-grams in every language."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def from_ordered(cls, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> Profiles:
        languages = tuple(sorted(profiles))
        found = [profiles[language] for language in languages]
        grams = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
        # The last row stands for n-grams that no language has.
        ranks = np.full((len(grams) + 1, len(languages)), size, dtype=np.int64)
        for number, profile in enumerate(found):
            ranks[np.searchsorted(grams, profile), number] = np.arange(len(profile))
        return cls(languages, grams, ranks, size)

    def distances(self, ordered: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ordered n-grams to each language."""
        at = np.searchsorted(self.grams, ordered)
        at[at == len(self.grams)] = 0
        rows = np.where(self.grams[at] == ordered, at, len(self.grams))
        ranks, own = self.ranks[rows], np.arange(len(ordered))[:, None]
        return np.where(ranks == self.size, self.size, np.abs(ranks - own)).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngram_counts(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        ordered = most_frequent(grams, counts, self.size)
        distances = self.distances(ordered)
        best = int(np.argmin(distances))
        if len(distances) == 1:
            return self.languages[0], float(1 - distances[0] / (self.size * len(ordered)))
        near, far = np.partition(distances, 1)[:2]
        return self.languages[best], float(far / (near + far)) if far else 0.5


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every value of ``lang`` in ``docs`` (``text``, ``lang``); rows where either is NULL are left out.

    A profile is collected; it has ``size`` n-grams per language.
    """
    pairs = docs.select(F.col("lang").cast("string").alias("lang"), "text").dropna()
    counts = pairs.mapInArrow(_language_counts, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("gram"), F.lit(_PARTS))
    ranked = totals.withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.col("n").desc(), "gram"))
    )
    best = ranked.where(F.col("place") <= size).select("lang", "gram", "n").toPandas()
    best = best.sort_values(["lang", "n", "gram"], ascending=[True, False, True])
    return Profiles.from_ordered(
        {language: rows["gram"].to_numpy()[:size].astype(np.uint64) for language, rows in best.groupby("lang")}, size
    )


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(profiles: Profiles, spark, text: Column | str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score`` for each whole text."""
    shared = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf(_PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(one) for one in texts], columns=_PREDICTED.names)

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang_pred``, ``score``."""
    found = docs.select("doc_id", predicted(profiles, docs.sparkSession).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
