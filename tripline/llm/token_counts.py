"""Token counts of whole texts by a unigram model, with dynamic programming shared along a trie.

A text is cut into pre-tokens, its runs of anything but ASCII white space, each
with the piece vocabulary's word sign in front. The number of tokens of a
pre-token is that of its best segmentation: the pieces with the largest sum of
log probabilities, the fewest pieces among equals. A piece's probability follows
Zipf's law in its rank in the vocabulary file; nothing is trained. A character
that no piece covers costs more than any piece and counts one token per byte.

The distinct pre-tokens of a batch are walked in the depth-first order of
their trie. The forward scores of the current path stand on a stack, so those
of a prefix are computed once for all pre-tokens that begin with it; the count
at each terminal is stored and remembered for later batches of the task.

NULL and empty texts have no tokens. Rows that repeat are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.common import words

WORD_SIGN = "▁"
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
_REMEMBERED = 250_000


def zipf_scores(ranks: dict[str, float]) -> dict[str, float]:
    """Log probabilities of pieces that fall with their rank by Zipf's law."""
    total = math.log(sum(1.0 / (rank + ZIPF_SHIFT) for rank in ranks.values()))
    return {piece: -math.log(rank + ZIPF_SHIFT) - total for piece, rank in ranks.items()}


def load_scores(model_path: str) -> dict[str, float]:
    """Scores of all text pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    numbers = range(model.get_piece_size())
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return zipf_scores(
        {model.id_to_piece(n): -model.get_score(n) for n in numbers if not any(test(n) for test in special)}
    )


class TrieCounter:
    """Counts tokens of pre-tokens under piece scores."""

    def __init__(self, scores: dict[str, float]):
        self._scores = scores
        self._unknown = (min(scores.values()) if scores else 0.0) - UNKNOWN_PENALTY
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        # Pieces that end in two given characters, or are one character, by length.
        self._lengths = {end: tuple(sorted(found)) for end, found in lengths.items() if len(end) == 2}

    def count(self, pretokens: list[str]) -> list[int]:
        """Number of tokens of each of the distinct ``pretokens``."""
        scores, lengths, unknown = self._scores, self._lengths, self._unknown
        best, tokens = [0.0], [0]
        found: dict[str, int] = {}
        previous = ""
        for pretoken in sorted(pretokens):
            # What this path shares with the one before it stays on the stack.
            shared = 0
            for a, b in zip(previous, pretoken):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(pretoken) + 1):
                last = pretoken[end - 1]
                single = scores.get(last)
                if single is None:
                    value, number = best[-1] + unknown, tokens[-1] + len(last.encode("utf-8", "surrogatepass"))
                else:
                    value, number = best[-1] + single, tokens[-1] + 1
                if end > 1:
                    for size in lengths.get(pretoken[end - 2 : end], ()):
                        if size > end:
                            break
                        score = scores.get(pretoken[end - size : end])
                        if score is not None:
                            other = best[end - size] + score
                            if other > value or (other == value and tokens[end - size] + 1 < number):
                                value, number = other, tokens[end - size] + 1
                best.append(value)
                tokens.append(number)
            found[pretoken] = tokens[-1]
            previous = pretoken
        return [found[pretoken] for pretoken in pretokens]


class TextCounter:
    """Counts tokens of texts; each distinct pre-token once while it is remembered."""

    def __init__(self, scores: dict[str, float]):
        self._trie = TrieCounter(scores)
        self._number: dict[bytes, int] = {}
        self._counts = np.zeros(0, dtype=np.int64)

    def forget(self) -> None:
        """Give back what the pre-tokens seen so far take."""
        self._number, self._counts = {}, np.zeros(0, dtype=np.int64)

    def count(self, texts) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        if len(self._number) > _REMEMBERED:
            self.forget()
        known, number = len(self._number), self._number
        numbered = [[number.setdefault(word, len(number)) for word in words(text)] for text in texts]
        new = [word.decode("utf-8", "surrogatepass") for word in list(number)[known:]]
        if new:
            counts = self._trie.count([WORD_SIGN + word for word in new])
            self._counts = np.concatenate((self._counts, np.array(counts, dtype=np.int64)))
        return [(len(found), int(self._counts[found].sum()) if found else 0) for found in numbered]


_COUNTERS: dict[str, TextCounter] = {}


def counter(model_path: str) -> TextCounter:
    """The counter of this process."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = TextCounter(load_scores(model_path))
    return _COUNTERS[model_path]


_COUNTED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(model_path: str, text: Column | str = "text") -> Column:
    """Struct of ``n_words`` (pre-tokens) and ``n_tokens`` of each whole text."""

    @F.pandas_udf(_COUNTED)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = counter(model_path)
        for texts in batches:
            yield pd.DataFrame(tool.count(list(texts)), columns=_COUNTED.names)
        tool.forget()

    return count(text)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_tokens``."""
    return docs.select("doc_id", token_counts(model_path).alias("counted")).select("doc_id", "counted.*")
