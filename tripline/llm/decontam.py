"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the normalised benchmark items is built once and streamed
over the words of each document. It tracks the longest suffix of the words
read so far that occurs in an item, held at the window length, so the state
names the window that ends at the current word and, through it, the items.

The benchmark is cut into shards of a bounded number of words; an item that is
longer goes into several, overlapping by a window. A task builds a shard's automaton
and stores it. One shard is broadcast at a time: the documents pass it, what it hits
is stored, and the hits of all shards are merged per document. So the driver and
a worker hold one automaton of bounded size, whatever the size of the benchmark.

Words are runs of ASCII letters (A to Z lowered), digits and all characters
from U+0080 on. A window is ``WINDOW`` consecutive words of an item; an item of
fewer words, but at least one, is one window. NULL and empty texts have no
words; repeated items count once by id; items without an id match but are not
named.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.operators.workdir import WorkDir

WINDOW = 10
#: Words of benchmark items in one automaton; it has at most twice as many states.
MAX_AUTOMATON_WORDS = 200_000
#: A document of which more than this share of words is hit is removed as a whole.
MAX_COVERAGE = 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words in text that is not lower-cased, as a Spark pattern.
_ITEM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def normalised(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall(normalised(text))


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set] = {}
        own_short: dict[int, dict[int, set]] = {}
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for item, sequence in items:
            if not sequence:
                continue
            whole = min(window, len(sequence))
            for position, state, matched in self.matches(sequence):
                if matched == window:
                    self.items.setdefault(state, set()).add(item)
                elif position == len(sequence) - 1 and len(sequence) < window:
                    own_short.setdefault(state, {}).setdefault(whole, set()).add(item)
        #: For each state the short items that are suffixes of what it can stand for.
        self.short: dict[int, list[tuple[int, set]]] = {}
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            found = list(self.short.get(self.link[state], ())) + list(own_short.get(state, {}).items())
            if found:
                self.short[state] = found

    def _extend(self, last: int, word: bytes) -> int:
        following = self.next[last].get(word)
        if following is not None:
            if self.length[following] == self.length[last] + 1:
                return following
            return self._clone(last, word, following)
        state = self._add(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != -1:
            other = self.next[at][word]
            self.link[state] = other if self.length[other] == self.length[at] + 1 else self._clone(at, word, other)
        return state

    def _clone(self, at: int, word: bytes, state: int) -> int:
        clone = self._add(self.length[at] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = clone
        while at != -1 and self.next[at].get(word) == state:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _add(self, length: int, transitions: dict[bytes, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def matches(self, sequence: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length (at most the window) of the longest match that ends at each matched word."""
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for position, word in enumerate(sequence):
            step = following[state].get(word)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = following[state].get(word)
            if step is None:
                continue
            state = step
            matched += 1
            if matched >= window:
                matched = window
                while length[link[state]] >= window:
                    state = link[state]
            yield position, state, matched

    def find(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges that windows occupy (merged, end exclusive) and the ids of their items."""
        ranges: list[list[int]] = []
        found: set = set()
        window, items, short = self.window, self.items, self.short
        for position, state, matched in self.matches(sequence):
            covered = 0
            if matched == window:
                covered = window
                found |= items[state]
            if state in short:
                for words, ids in short[state]:
                    if words <= matched:
                        covered = max(covered, words)
                        found |= ids
            if covered:
                start = position + 1 - covered
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append([start, position + 1])
        found.discard(None)
        return [(start, end) for start, end in ranges], found


_SHARD = "shard long, automaton binary"


def _built(key: tuple, items: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = items.sort_values(["item_id", "text"], na_position="first")
    built = SuffixAutomaton([(item, split_words(text)) for item, text in zip(rows["item_id"], rows["text"])], window)
    return pd.DataFrame([(int(key[0]), pickle.dumps(built, pickle.HIGHEST_PROTOCOL))], columns=["shard", "automaton"])


def _parts(items: DataFrame, window: int, max_words: int) -> DataFrame:
    """Items with their number of words; a longer one in parts that overlap, so that each window is whole in one of them."""
    words = F.regexp_extract_all("text", F.lit(f"({_ITEM_WORD})"), F.lit(1))
    step = max(max_words - window + 1, 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    long = items.where(F.regexp_count("text", F.lit(_ITEM_WORD)) > max_words).withColumn("words", words)
    long = long.select("item_id", "words", F.explode(starts).alias("start"))
    cut = long.select("item_id", F.array_join(F.slice("words", F.col("start") + 1, F.lit(step + window - 1)), " ").alias("text"))
    short = items.where(F.regexp_count("text", F.lit(_ITEM_WORD)) <= max_words)
    return short.unionByName(cut).withColumn("words", F.regexp_count("text", F.lit(_ITEM_WORD)))


def automata(
    benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_AUTOMATON_WORDS, *, work: WorkDir | None = None
) -> Shards:
    """The automata of all shards, built by tasks and stored; each has about ``max_words`` words."""
    work = work or WorkDir.for_session(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    items = work.store(_parts(items.where(F.col("text").isNotNull()).distinct(), window, max_words), "items")
    total = items.agg(F.sum("words").alias("words")).first()["words"] or 0
    shards = max(1, -(-total // max_words))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")
    build = lambda key, rows: _built(key, rows, window)
    built = items.where(F.col("words") > 0).select(shard, "item_id", "text").groupBy("shard").applyInPandas(build, _SHARD)
    stored = work.store(built, "automata")
    return Shards(stored, sorted(row["shard"] for row in stored.select("shard").collect()))


@dataclass
class Shards:
    """Stored automata and their numbers."""

    stored: DataFrame
    numbers: list[int]

    def __len__(self) -> int:
        return len(self.numbers)

    @contextmanager
    def one(self, number: int) -> Iterator[Broadcast]:
        """The automaton of one shard, whose size is bounded, on every worker for as long as it is used."""
        shard = self._broadcast(number)
        try:
            yield shard
        finally:
            shard.destroy()

    def _broadcast(self, number: int | None) -> Broadcast:
        if number is None:
            built = SuffixAutomaton([])
        else:
            built = pickle.loads(self.stored.where(F.col("shard") == number).select("automaton").first()["automaton"])
        return self.stored.sparkSession.sparkContext.broadcast(built)

    def only(self) -> Broadcast:
        """The automaton of the only shard, or one without items."""
        return self._broadcast(self.numbers[0] if self.numbers else None)


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _find_with(automaton: Broadcast):
    """A column function that finds what one automaton hits."""

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan = automaton.value.find
        for texts in batches:
            rows = []
            for text in texts:
                sequence = split_words(text)
                ranges, ids = scan(sequence)
                rows.append((len(sequence), [r[0] for r in ranges], [r[1] for r in ranges], sorted(ids)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return find


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(_SPANS)
def _merged(found: pd.Series) -> pd.Series:
    """Ranges in order, those that touch as one."""
    merged = [_merge([(span["start"], span["end"]) for span in spans]) for spans in found]
    return pd.Series([[{"start": start, "end": end} for start, end in spans] for spans in merged])


def _hits(rows: DataFrame, shards: Shards, work: WorkDir) -> DataFrame:
    """``row``, ``spans`` and ``items`` of the rows (``row``, ``text``) that some shard hits; the shards pass one after the other."""
    parts = []
    for number in shards.numbers:
        with shards.one(number) as automaton:
            found = rows.select("row", _find_with(automaton)(F.col("text")).alias("found")).where(F.size("found.starts") > 0)
            parts.append(work.store(found, "hits"))
    # As many lists as shards hit a row.
    spans = F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.ends").alias("end"))
    return reduce(DataFrame.unionAll, parts).groupBy("row").agg(
        F.flatten(F.collect_list(spans)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
    ).withColumn("spans", _merged("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, work: WorkDir | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` (word ranges that are hit), ``items``."""
    work = work or WorkDir.for_session(docs.sparkSession)
    shards = automata(benchmark, window, work=work)
    if len(shards) > 1:
        rows = work.store(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
        hits = work.store(_hits(rows, shards, work).withColumnRenamed("row", "of_row"), "found")
        return rows.join(hits, F.col("row") == F.col("of_row"), "left").select(
            "doc_id",
            F.coalesce(F.regexp_count("text", F.lit(_ITEM_WORD)), F.lit(0)).cast("long").alias("n_words"),
            F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    found = docs.select("doc_id", _find_with(shards.only())(F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        "found.n_words",
        F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.ends").alias("end")).alias("spans"),
        "found.items",
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


_CLEANED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
    ]
)


def cut_out(text: str, ranges: list[tuple[int, int]]) -> str:
    """Text without the words of some ranges and what stands between them."""
    places = [match.span() for match in _WORD.finditer(normalised(text))]
    source, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in ranges:
        kept.append(source[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(source[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def clean_text(text: str | None, automaton: SuffixAutomaton) -> tuple[str | None, int, int]:
    """Text without its hit words and what stands between them, its words before, and how many were removed.

    Removing a span can bring words together that form a window, so the text
    is read again until nothing is hit.
    """
    removed, words = 0, None
    while True:
        sequence = split_words(text)
        words = len(sequence) if words is None else words
        ranges = automaton.find(sequence)[0]
        if not ranges:
            return text, words, removed
        text = cut_out(text, ranges)
        removed += sum(end - start for start, end in ranges)


def _clean_with(automaton: Broadcast):
    @F.pandas_udf(_CLEANED)
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [clean_text(text, automaton.value) for text in texts]
            yield pd.DataFrame(rows, columns=["text", "n_words", "n_hit"])

    # Spark would otherwise clean every text twice, for the filter and for the result, with two workers per task.
    return clean.asNondeterministic()


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_out(text, [(s["start"], s["end"]) for s in found]) for text, found in zip(texts, spans)], dtype=object)


def _cleaned_by_all(rows: DataFrame, shards: Shards, work: WorkDir) -> DataFrame:
    """``rows`` (``row``, ``text``, others) with the cleaned ``text``, its ``words`` before and how many were ``cut``.

    What all shards hit is merged before it is cut, so windows that overlap are cut whole
    whichever shards they are in. Only texts that were cut are read again.
    """
    rows = work.store(rows.withColumn("words", F.coalesce(F.regexp_count("text", F.lit(_ITEM_WORD)), F.lit(0))), "rows")
    active, rounds = rows.select("row", "text", F.lit(0).cast("long").alias("cut")), []
    while True:
        hits = work.store(_hits(active, shards, work).select(F.col("row").alias("of_row"), "spans"), "found")
        if hits.isEmpty():
            break
        joined = active.join(hits, F.col("row") == F.col("of_row"))
        cut = joined.select("row", _cut("text", "spans").alias("text"), (F.col("cut") + hit_words(F.col("spans"))).alias("cut"))
        active = work.store(cut, "cut")
        rounds.append(active.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return rows.withColumn("cut", F.lit(0).cast("long"))
    last = reduce(DataFrame.unionAll, rounds).groupBy(F.col("row").alias("of_row")).agg(
        F.max_by(F.struct("text", "cut"), "round").alias("last")
    )
    joined = rows.join(last, F.col("row") == F.col("of_row"), "left")
    text = F.when(F.col("last").isNotNull(), F.col("last.text")).otherwise(F.col("text"))
    return joined.withColumn("cut", F.coalesce("last.cut", F.lit(0).cast("long"))).withColumn("text", text).drop("of_row", "last")


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    work: WorkDir | None = None,
) -> DataFrame:
    """``docs`` without benchmark passages; columns as they were.

    Every span made of windows is cut out of the text; a document of which
    more than ``max_coverage`` of the words would be cut is removed. ``n_chars``
    follows the text where the table has it and the text changed.
    """
    work = work or WorkDir.for_session(docs.sparkSession)
    shards = automata(benchmark, window, work=work)
    names = [f"c{position}" for position in range(len(docs.columns))]
    at = docs.columns.index("text")
    out = docs.toDF(*[*names[:at], "text", *names[at + 1 :]])
    if len(shards) > 1:
        out = _cleaned_by_all(out.withColumn("row", F.monotonically_increasing_id()), shards, work)
    else:
        out = out.withColumn("cleaned", _clean_with(shards.only())("text"))
        out = out.withColumn("words", F.col("cleaned.n_words")).withColumn("cut", F.col("cleaned.n_hit"))
        out = out.withColumn("text", F.col("cleaned.text"))
    if "n_chars" in docs.columns:
        chars = names[docs.columns.index("n_chars")]
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            chars, F.when(F.col("cut") > 0, F.length("text").cast(kind)).otherwise(F.col(chars))
        )
    kept = out.where(F.col("cut") <= max_coverage * F.col("words"))
    return kept.select(*[*names[:at], "text", *names[at + 1 :]]).toDF(*docs.columns)
