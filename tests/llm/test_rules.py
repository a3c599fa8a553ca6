from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import rules

TEXTS = [
    None,
    "",
    " \n ",
    "a",
    "a b c a b c",
    "a b a b a b",
    "x y z\nx y z\n\nx y z \n# $ %",
    "É é <b>|&*\x1c\t q\x0bw",
    "same " * 60,
    " ".join(f"w{n % 17} w{n % 5}" for n in range(200)),
]


def brute(text):
    """words, characters in them, symbols, repeated lines, words in repeated windows."""
    spaces = " \t\n\x0b\x0c\r"
    split = lambda s: [w for w in "".join(" " if c in spaces else c for c in s).split(" ") if w]
    words = split(text or "")
    lines = [line for line in (text or "").split("\n") if split(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, window in enumerate(windows) if often[window] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(inside),
    )


@pytest.mark.parametrize("text", TEXTS)
def test_base_statistics(text):
    assert rules.text_statistics(text)[:5] == brute(text)


def test_random_statistics():
    state = random.Random(1)
    for _ in range(300):
        text = "".join(state.choice(["a", "b", "é", " ", "  ", "\n", "#", "|", "\r"]) for _ in range(state.randint(0, 60)))
        assert rules.text_statistics(text)[:5] == brute(text)


def test_covering_learns_a_conjunction_and_ignores_noise():
    state = np.random.default_rng(2)
    data = {name: state.random(3000) for name in ("words", "symbols_per_word", "upper_share")}
    rejected = (data["symbols_per_word"] > 0.7) & (data["upper_share"] <= 0.4)
    found = rules.learn(data, rejected, np.arange(3000) % 3 == 2)
    decided = np.zeros(3000, dtype=bool)
    for rule in found:
        decided |= rules._covered(rule, data, 3000)
    assert (decided == rejected).mean() > 0.99
    assert all({c.feature for c in rule} <= {"symbols_per_word", "upper_share"} for rule in found)
    noise = state.random(3000) < 0.1
    assert rules.learn(data, noise, np.arange(3000) % 3 == 2) == []


def labelled(spark, documents):
    good = [(n, " ".join(f"word{n}x{k}" for k in range(60 + n % 7))) for n in range(120)]
    bad = [(n, " ".join(f"word{n}x{k}###" for k in range(60 + n % 7))) for n in range(120, 240)]
    docs = documents([*good, *bad, (300, None), (301, "short"), (302, "x y " * 60), (None, good[0][1])])
    rows = [(n, 1, 0) for n in range(120)] + [(n, 0, 0) for n in range(120, 240)] + [(5, None, 0), (None, 0, 0), (7, 1, 1)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_learned_list_and_base_rules(spark, documents):
    docs, labels = labelled(spark, documents)
    learned = rules.learn_rules(docs, labels)
    assert learned and str(learned[0][0])
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judge(docs, learned).collect()}
    assert all(found[n] == (False, True) for n in range(120))
    assert all(found[n] == (False, False) for n in range(120, 240))
    assert [found[n] for n in (300, 301, 302)] == [(True, False)] * 3
    kept = rules.keep_accepted(docs, learned)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {*range(120), None}


def test_without_labels_only_the_base_rules_reject(spark, documents):
    docs, labels = labelled(spark, documents)
    assert rules.learn_rules(docs, labels.limit(0)) == []
    assert rules.learn_rules(docs, labels.where(F.col("quality") == 1)) == []
    assert rules.judge(docs.limit(0), []).count() == 0
    assert rules.keep_accepted(docs, []).count() == 241
