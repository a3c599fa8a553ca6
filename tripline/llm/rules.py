"""Quality rules: text statistics and a decision list learned from labelled ones.

The list is learned by sequential covering. Each rule is a conjunction of
thresholds on the statistics, grown on two thirds of the labelled rows by
information gain, pruned from its end on the other third, and kept as long as
it is precise there; the rows it covers are set aside and the next rule is
learned from the rest. The result is an ordered Spark conditional expression.

NULL texts have no words and no lines. Labelled rows with a NULL label and
texts without a row in the labels are not learned from. Without labels of both
kinds the list is empty and rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.common import bounded_labels, words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 3
#: Labelled rows the list is learned from at most; chosen by hash of the id.
MAX_LABELLED = 40_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_letters", "n_digits", "n_distinct_words", "n_short_lines", "n_marks", "longest_run")
STATISTICS = T.StructType([T.StructField(name, T.LongType()) for name in _BASE + _MORE])

_SYMBOL_BYTES = SYMBOLS.encode()
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = b"!?.,;:"
SHORT_LINE_WORDS = 4


def _repeats(codes: np.ndarray, distinct: int) -> int:
    """Words inside a three-word window that the text holds twice or more."""
    count = len(codes) - REPEAT_WINDOW + 1
    if count < 2:
        return 0
    # Two steps keep the numbers below 2**63 for any text: pairs are numbered anew before the third word joins.
    pairs = codes[:-1] * distinct + codes[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1].astype(np.int64) * distinct + codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(count, dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(codes), dtype=bool)
    for offset in range(REPEAT_WINDOW):
        covered[offset : offset + count] |= twice
    return int(covered.sum())


def _longest_run(codes: np.ndarray) -> int:
    if not len(codes):
        return 0
    edges = np.flatnonzero(np.diff(codes)) + 1
    return int(np.diff(np.concatenate(([0], edges, [len(codes)]))).max())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text."""
    found = words(text)
    if text is None:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(word, len(numbers)) for word in found], dtype=np.int64)
    lines = [line for line in raw.split(b"\n") if line.split()]
    inner = [line.strip() for line in lines]
    word_bytes = b"".join(found)
    letters = sum(map(str.isalpha, text))
    return (
        len(found),
        len(word_bytes.decode("utf-8", "surrogatepass")),
        sum(map(raw.count, (bytes([symbol]) for symbol in _SYMBOL_BYTES))),
        len(lines) - len(set(lines)),
        _repeats(codes, len(numbers)),
        len(lines),
        len(_UPPER.findall(text)),
        letters,
        sum(map(raw.count, (bytes([digit]) for digit in b"0123456789"))),
        len(numbers),
        sum(len(line.split()) < SHORT_LINE_WORDS for line in inner),
        sum(map(raw.count, (bytes([mark]) for mark in _MARKS))),
        _longest_run(codes),
    )


@F.pandas_udf(STATISTICS)
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_statistics(text) for text in texts], columns=STATISTICS.names)


def statistics(text: Column | str) -> Column:
    """Struct of counts of a text; every document is measured on its whole text."""
    return _statistics(text)


def _share(part: str, whole: str):
    return lambda stats: stats[part] / F.greatest(stats[whole], F.lit(1))


#: Interpretable measures that rules put thresholds on.
FEATURES = {
    "words": lambda stats: stats["n_words"].cast("double"),
    "chars_per_word": _share("word_chars", "n_words"),
    "symbols_per_word": _share("n_symbols", "n_words"),
    "duplicate_line_share": _share("n_dup_lines", "n_lines"),
    "repeated_word_share": _share("n_repeat_words", "n_words"),
    "words_per_line": _share("n_words", "n_lines"),
    "upper_share": _share("n_upper", "n_letters"),
    "letter_share": _share("n_letters", "word_chars"),
    "digit_share": _share("n_digits", "word_chars"),
    "distinct_word_share": _share("n_distinct_words", "n_words"),
    "short_line_share": _share("n_short_lines", "n_lines"),
    "marks_per_word": _share("n_marks", "n_words"),
    "longest_run_share": _share("longest_run", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        values = data[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, stats: Column) -> Column:
        value = FEATURES[self.feature](stats)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, data: dict[str, np.ndarray], size: int) -> np.ndarray:
    mask = np.ones(size, dtype=bool)
    for condition in rule:
        mask &= condition.mask(data)
    return mask


def _information(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.log2((good + 0.5) / (good + bad + 1.0))


def _best_condition(data: dict[str, np.ndarray], wanted: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain for ``wanted`` rows; ties: the first feature, lowest value."""
    total, size = int(wanted.sum()), len(wanted)
    base = _information(np.float64(total), np.float64(size - total))
    best, chosen = 1e-9, None
    for feature, values in data.items():
        order = np.argsort(values, kind="stable")
        ranked, hits = values[order], np.cumsum(wanted[order])
        cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
        if not len(cuts):
            continue
        low_hits, low_all = hits[cuts], cuts + 1
        for above in (False, True):
            p = total - low_hits if above else low_hits
            n = (size - low_all if above else low_all) - p
            gain = p * (_information(p, n) - base)
            at = int(np.argmax(gain))
            if gain[at] > best + 1e-9:
                best = float(gain[at])
                chosen = Condition(feature, above, float((ranked[cuts[at]] + ranked[cuts[at] + 1]) / 2))
    return best, chosen


def _grow(data: dict[str, np.ndarray], wanted: np.ndarray, max_conditions: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(wanted), dtype=bool)
    while len(rule) < max_conditions and wanted[inside].any() and not wanted[inside].all():
        _, condition = _best_condition({name: values[inside] for name, values in data.items()}, wanted[inside])
        if condition is None:
            break
        rule.append(condition)
        inside &= condition.mask(data)
    return tuple(rule)


def _prune(rule: Rule, data: dict[str, np.ndarray], wanted: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule with the best precision on rows it was not grown on, that precision, rows covered."""
    best: tuple[Rule, float, int] = ((), -math.inf, 0)
    for size in range(1, len(rule) + 1):
        mask = _covered(rule[:size], data, len(wanted))
        hits, rows = int(wanted[mask].sum()), int(mask.sum())
        precision = (hits + 1) / (rows + 2)
        if precision > best[1] + 1e-3:
            best = (rule[:size], precision, hits)
    return best


def learn(
    data: dict[str, np.ndarray],
    rejected: np.ndarray,
    for_pruning: np.ndarray,
    min_precision: float = 0.75,
    min_hits: int = 2,
    max_rules: int = 12,
    max_conditions: int = 4,
) -> list[Rule]:
    """Ordered rules that reject, by sequential covering."""
    rules: list[Rule] = []
    left = np.ones(len(rejected), dtype=bool)
    while len(rules) < max_rules:
        growing, pruning = left & ~for_pruning, left & for_pruning
        if not rejected[growing].any():
            break
        rule = _grow({name: values[growing] for name, values in data.items()}, rejected[growing], max_conditions)
        rule, precision, hits = _prune(
            rule, {name: values[pruning] for name, values in data.items()}, rejected[pruning]
        )
        if precision < min_precision or hits < min_hits:
            break
        rules.append(rule)
        left &= ~_covered(rule, data, len(rejected))
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> pd.DataFrame:
    """Features and ``rejected`` of about ``max_rows`` labelled documents at most, the same ones in every run."""
    chosen = bounded_labels(labels, "quality", max_rows)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    stats = texts.select("doc_id", "quality", statistics("text").alias("stats"))
    rows = stats.select(
        "doc_id",
        (F.col("quality") == 0).alias("rejected"),
        *(build(F.col("stats")).alias(name) for name, build in FEATURES.items()),
    )
    found = rows.toPandas()
    return found.sort_values(["doc_id", *FEATURES]).drop_duplicates("doc_id").reset_index(drop=True)


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[Rule]:
    rows = labelled_statistics(docs, labels, max_rows)
    data = {name: rows[name].to_numpy(dtype=np.float64) for name in FEATURES}
    rejected = rows["rejected"].to_numpy(dtype=bool)
    for_pruning = np.arange(len(rows)) % 3 == 2
    return learn(data, rejected, for_pruning)


def accepted(rules: list[Rule], stats: Column) -> Column:
    """The decision list: the first rule that holds rejects; a text that meets none is accepted."""
    decision = None
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(stats)
        decision = F.when(holds, F.lit(False)) if decision is None else decision.when(holds, F.lit(False))
    return F.lit(True) if decision is None else decision.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"]
    )


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, all statistics, ``base_failed`` and ``kept``."""
    stats = docs.select("doc_id", statistics("text").alias("stats"))
    found = stats.select("doc_id", "stats.*", base_failed(F.col("stats")).alias("base_failed"), "stats")
    return found.withColumn("kept", ~F.col("base_failed") & accepted(rules, F.col("stats"))).drop("stats")


def keep_accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` without the rows that the base rules or the learned list reject; columns as they were."""
    names = [f"c{position}" for position in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    out = docs.toDF(*names).withColumn("stats", statistics(text))
    stats = F.col("stats")
    return out.where(~base_failed(stats) & accepted(rules, stats)).select(*names).toDF(*docs.columns)
