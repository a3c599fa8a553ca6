from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tripline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: weights[n % len(weights)] for n, name in enumerate(names)}
    limit = {name: cap * sizes[name] for name in names}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[name] for name in free)
        above = {name for name in free if weight[name] * level > limit[name]}
        if not above:
            target.update({name: weight[name] * level for name in free})
            break
        for name in above:
            target[name] = limit[name]
            left -= limit[name]
        free -= above
    return target


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 1000, "c": 50, None: 10}, {"é": 7, "z": 9}, {None: 4}, {"a": 0, "b": 10}, {"a": 0}],
)
def test_targets_are_shared_by_weight_up_to_the_cap(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-9)


def corpus(documents, seed=3):
    rows = []
    for n in range(900):
        source = ("big", "mid", "low", None)[0 if n % 3 == 0 else 1 + n * n % 3]
        rows.append((n, " ".join(["w"] * (1 + (n * 7919 + seed) % 230)), None, source))
    return documents(rows)


def test_taken_words_come_near_their_targets(documents, work):
    docs = corpus(documents)
    found = mixing.mix(mixing.sized(docs), work)
    taken = F.sum(F.col(mixing.SIZE) * F.col(mixing.COPIES)).alias("taken")
    sources = found.groupBy("source").agg(taken, F.max(mixing.TARGET).alias("target"), F.max(mixing.COPIES).alias("most"))
    for row in sources.collect():
        assert abs(row["taken"] - row["target"]) <= 0.02 * row["target"]
        assert row["most"] <= 2
    again = mixing.mix(mixing.sized(docs.repartition(7)), work)
    assert rows_of(found, "doc_id", mixing.COPIES) == rows_of(again, "doc_id", mixing.COPIES)


def test_copies_weigh_as_one_text_and_take_newton_steps(documents, work):
    """A third of a source's rows are one text: its rate is lower, and the target is met all the same."""
    texts = ["copied " * 40 if n % 3 == 0 else f"own{n} " * (1 + n % 90) for n in range(600)]
    docs = documents([(n, text, None, "a" if n % 2 else "b") for n, text in enumerate(texts)])
    found = mixing.mix(mixing.sized(docs), work)
    rates = {(r["source"], r["text"].startswith("copied")): set() for r in docs.collect()}
    for row in found.collect():
        rates[row["source"], row["text"].startswith("copied")].add(round(row[mixing.RATE], 9))
    assert all(len(rate) == 1 for rate in rates.values())
    for source in "ab":
        copied, own = (next(iter(rates[source, which])) for which in (True, False))
        plain = found.where(F.col("source") == source).select(F.col(mixing.TARGET) / F.col(mixing.SOURCE_SIZE)).first()[0]
        # The first source is taken twice as a whole; the other one's words are met by unequal rates.
        assert copied == plain == own == 2 if source == "a" else copied < plain < own <= 2
        assert own == 2 or copied == pytest.approx(own / 100)
    taken = F.sum(F.col(mixing.SIZE) * F.col(mixing.COPIES)).alias("taken")
    for row in found.groupBy("source").agg(taken, F.max(mixing.TARGET).alias("target")).collect():
        assert abs(row["taken"] - row["target"]) <= 0.02 * row["target"]


def test_a_source_of_copies_that_is_taken_twice(documents, work):
    """Its target is twice its size, so every rate must reach the cut."""
    docs = documents([(n, "same text", None, "a") for n in range(50)] + [(100, "alone here", None, "a"), (101, "w " * 900, None, "b")])
    found = mixing.mix(mixing.sized(docs), work)
    assert {r[mixing.COPIES] for r in found.where("source = 'a'").collect()} == {2}


def test_newton_steps_meet_the_constraints_with_base_rates_and_a_cut(spark, work):
    cells = [("a", 1.0, 100), ("a", 5.0, 40), ("a", 0.1, 60), ("b", 1.0, 10)]
    targets = spark.createDataFrame([("a", 200, 4, 210.0), ("b", 10, 1, 3.0)], "source string, source_size long, n_docs long, target double")
    found = mixing.balance(spark.createDataFrame(cells, "source string, base double, size long"), targets, work)
    tilt = {r["source"]: r["tilt"] for r in found.collect()}
    for source, target in (("a", 210.0), ("b", 3.0)):
        words = sum(size * min(2.0, base * math.exp(tilt[source])) for s, base, size in cells if s == source)
        assert words == pytest.approx(target, rel=1e-6)


def test_nulls_empty_texts_and_repeats(documents, work):
    docs = documents([(1, None, None, "a"), (2, "", None, "a"), (3, "x y", None, None), (3, "x y", None, None), (None, "z", None, "b")])
    found = mixing.mix(mixing.sized(docs), work)
    assert found.count() == 5
    assert {r[mixing.SIZE] for r in found.where(F.col("source") == "a").collect()} == {0}
    assert mixing.mixed_documents(docs, work).schema == docs.schema


def test_mixed_documents_are_rows_repeated(documents, work):
    docs = corpus(documents)
    copies = {r["doc_id"]: r[mixing.COPIES] for r in mixing.mix(mixing.sized(docs), work).collect()}
    counted = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(docs, work).groupBy("doc_id").count().collect()}
    assert counted == {doc_id: n for doc_id, n in copies.items() if n}


def test_empty_table(documents, work):
    assert mixing.mix(mixing.sized(documents([])), work).count() == 0
    assert mixing.mixed_documents(documents([]), work).count() == 0
