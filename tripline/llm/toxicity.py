"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

The features of a text are the selected words and beginnings of words it holds. They are selected by
how strongly their presence goes with the label ``toxic`` in a bounded sample of
labelled texts. The sample's severity grades are derived from the label: 0 for
label 0; for label 1 the number of strong whole words in the text, 1 for at most
one, 2 for two or three, 3 for more. One weight per word is shared by all grades;
ordered thresholds cut the weighted sum into the probability of each grade:
``P(grade > k) = sigmoid(w.x - threshold_k)``.

The result is the expected severity, the sum of ``P(grade > k)``, the most
probable grade, and whether grade 1 or above is at least even. NULL and empty
texts hold no words and get the prior. Labelled rows with a NULL label or id
are not learned from. With labels of one kind only, or none, every text gets
grade 0 and severity 0 (all label 0 or none) or 1 (all label 1).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.common import bounded_labels

GRADES = 4
#: Labelled rows learned from, and words with a weight.
MAX_LABELLED = 30_000
MAX_WORDS = 8_000
MIN_TEXTS = 4
#: Standard errors by which the log odds of a strong word exceed 0.
STRONG = 4.0
SELECTED = 1.5
#: Lengths of word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    """Lower-cased words of a whole text and, marked by ``^``, what they begin with."""
    found = set(_WORD.findall(text.lower())) if text else set()
    found.update([f"^{word[:size]}" for word in found for size in PREFIXES if len(word) >= size])
    return found


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with_label, without = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (with_label if toxic else without).update(distinct_words(text))
    words = sorted(with_label.keys() | without.keys())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(words, pa.string()),
            pa.array([with_label[w] for w in words], pa.int64()),
            pa.array([without[w] for w in words], pa.int64()),
        ],
        names=["word", "toxic", "clean"],
    )


def select_words(sample: DataFrame, n_toxic: int, n_clean: int, max_words: int = MAX_WORDS) -> dict[str, float]:
    """Words by the standardised log odds of their presence, the strongest ``max_words`` at most; ties by word."""
    counts = sample.select((F.col("toxic") == 1).alias("toxic"), "text").mapInArrow(
        _presence, "word string, toxic long, clean long"
    )
    a, b = F.sum("toxic") + 0.5, F.sum("clean") + 0.5
    totals = counts.groupBy("word").agg(a.alias("a"), b.alias("b")).where(F.col("a") + F.col("b") > MIN_TEXTS)
    c, d = F.lit(n_toxic + 1.0) - F.col("a"), F.lit(n_clean + 1.0) - F.col("b")
    odds = F.log(F.col("a") / c) - F.log(F.col("b") / d)
    error = F.sqrt(1 / F.col("a") + 1 / c + 1 / F.col("b") + 1 / d)
    rows = (
        totals.select("word", (odds / error).alias("z"))
        .where(F.abs("z") >= SELECTED)
        .orderBy(F.abs("z").desc(), "word")
        .limit(max_words)
        .collect()
    )
    return {row["word"]: row["z"] for row in rows}


def grade(toxic: int, words: set[str], strong: set[str]) -> int:
    """The severity a labelled text counts as in training."""
    if not toxic:
        return 0
    held = len(words & strong)
    return 1 if held <= 1 else 2 if held <= 3 else 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Shared weights and ordered thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, most probable grade and whether grade 1 or above is at least even."""
        number = self.words
        sums = np.array(
            [sum(self.weights[number[w]] for w in sorted(distinct_words(text)) if w in number) for text in texts],
            dtype=np.float64,
        ).reshape(-1, 1)
        above = _sigmoid(sums - self.thresholds)
        edges = np.concatenate((np.ones_like(sums), above, np.zeros_like(sums)), axis=1)
        return above.sum(axis=1), np.argmax(edges[:, :-1] - edges[:, 1:], axis=1), above[:, 0] >= 0.5


def fit(
    rows: list[list[int]], grades: np.ndarray, n_words: int, steps: int = 400, rate: float = 0.05, decay: float = 2e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds with the largest likelihood, by Adam; the same for the same rows.

    The first threshold is free, the gaps to the next are kept positive by
    fitting their logarithms.
    """
    index = np.array([word for row in rows for word in row], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    share = [np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(GRADES - 1)]
    base = -np.log(np.array(share) / (1 - np.array(share)))
    values = np.concatenate((np.zeros(n_words), base[:1], np.log(np.maximum(np.diff(base), 0.1))))
    mean, square = np.zeros_like(values), np.zeros_like(values)
    at = np.arange(len(grades))
    for step in range(1, steps + 1):
        gaps = np.exp(values[n_words + 1 :])
        thresholds = values[n_words] + np.concatenate(([0.0], np.cumsum(gaps)))
        sums = np.bincount(owner, values[index], minlength=len(grades))
        above = _sigmoid(sums[:, None] - thresholds)
        edges = np.concatenate((np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))), axis=1)
        slopes = edges * (1 - edges)
        chance = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        upper, lower = slopes[at, grades] / chance, slopes[at, grades + 1] / chance
        by_sum = -(upper - lower) / len(grades)
        by_threshold = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            by_threshold[k] = (upper[grades == k + 1].sum() - lower[grades == k].sum()) / len(grades)
        later = np.cumsum(by_threshold[::-1])[::-1]
        slope = np.concatenate(
            (
                np.bincount(index, by_sum[owner], minlength=n_words) + decay * values[:n_words],
                [later[0]],
                later[1:] * gaps,
            )
        )
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        values -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(values[n_words + 1 :])
    return values[:n_words], values[n_words] + np.concatenate(([0.0], np.cumsum(gaps)))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """Fit on about ``max_rows`` labelled documents at most."""
    chosen = bounded_labels(labels, "toxic", max_rows)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    counts = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), sum(n for label, n in counts.items() if label != 1)
    if not n_toxic or not n_clean:
        certain = 40.0
        return Model({}, np.zeros(0), np.array([-certain if n_toxic else certain, certain, certain]))
    scores = select_words(sample, n_toxic, n_clean)
    words = {word: number for number, word in enumerate(sorted(scores))}
    strong = {word for word, z in scores.items() if z >= STRONG and word[0] != "^"}
    shared = docs.sparkSession.sparkContext.broadcast((words, strong))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, marked = shared.value
        for batch in batches:
            held = [distinct_words(text) for text in batch.column(2).to_pylist()]
            found = [sorted(number[w] for w in words if w in number) for words in held]
            grades = [grade(toxic == 1, words, marked) for toxic, words in zip(batch.column(1).to_pylist(), held)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grades, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "grade", "words"],
            )

    schema = T.StructType(
        [
            sample.schema["doc_id"],
            T.StructField("grade", T.LongType()),
            T.StructField("words", T.ArrayType(T.LongType())),
        ]
    )
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(features, schema).toPandas()
    rows["words"] = rows["words"].map(lambda found: tuple(int(x) for x in found))
    rows = rows.sort_values(["doc_id", "grade", "words"]).drop_duplicates("doc_id")
    weights, thresholds = fit([list(x) for x in rows["words"]], rows["grade"].to_numpy(dtype=np.int64), len(words))
    return Model(words, weights, thresholds)


_PREDICTED = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic", T.BooleanType()),
    ]
)


def severity(model: Model, spark, text: Column | str = "text") -> Column:
    """Struct of ``severity``, ``grade`` and ``toxic`` for each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            expected, grades, toxic = shared.value.predict(list(texts))
            yield pd.DataFrame({"severity": expected, "grade": grades.astype(np.int32), "toxic": toxic})

    return predict(text)
