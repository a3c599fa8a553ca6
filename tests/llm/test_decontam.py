from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tripline.llm import decontam
from tripline.llm.decontam import SuffixAutomaton, split_words

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def brute(items, sequence, window):
    hit, ids = set(), set()
    for item, words in items:
        width = min(window, len(words))
        for window_start in range(len(words) - width + 1 if width else 0):
            content = words[window_start : window_start + width]
            for at in range(len(sequence) - width + 1):
                if sequence[at : at + width] == content:
                    hit.update(range(at, at + width))
                    ids.add(item)
    return hit, ids


@pytest.mark.parametrize("seed", range(8))
def test_automaton_finds_what_brute_force_finds(seed):
    state = random.Random(seed)
    for _ in range(150):
        window = state.randint(1, 4)
        letters = [b"a", b"b", b"c"][: state.randint(2, 3)]
        items = [(str(n), [state.choice(letters) for _ in range(state.randint(0, 7))]) for n in range(state.randint(0, 4))]
        sequence = [state.choice([*letters, b"z"]) for _ in range(state.randint(0, 20))]
        ranges, ids = SuffixAutomaton(items, window).find(sequence)
        assert ({w for a, b in ranges for w in range(a, b)}, ids) == brute(items, sequence, window)


def test_words():
    assert split_words("A-b c3É x's") == [b"a", b"b", "c3É x".encode(), b"s"]
    assert split_words(None) == split_words(" .,") == []


def found(spark, documents, docs, items, **more):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_contamination(documents(docs), benchmark, **more)
    return {
        row["doc_id"]: (row["n_words"], [(s["start"], s["end"]) for s in row["spans"]], row["items"])
        for row in out.collect()
    }


def test_contamination_of_nulls_short_items_and_repeats(spark, documents):
    docs = [(1, f"x {PASSAGE} y"), (2, "say Short-item now"), (3, None), (4, ""), (None, PASSAGE)]
    items = [(10, PASSAGE), (9, PASSAGE), (9, PASSAGE), (7, "short item"), (6, ""), (5, None), (None, "y")]
    assert found(spark, documents, docs, items) == {
        1: (14, [(1, 14)], ["10", "9"]),
        2: (4, [(1, 3)], ["7"]),
        3: (0, [], []),
        4: (0, [], []),
        None: (12, [(0, 12)], ["10", "9"]),
    }


def test_shards_give_what_one_automaton_gives(spark, documents, monkeypatch):
    docs = [(1, f"x {PASSAGE} y w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 z")]
    items = [(10, PASSAGE), (2, " ".join(f"w{n}" for n in range(1, 12))), (3, "z")]
    whole = found(spark, documents, docs, items)
    monkeypatch.setattr(decontam.automata, "__defaults__", (10, 12))
    assert found(spark, documents, docs, items) == whole


def test_an_item_longer_than_a_shard_is_cut_with_overlap(spark, documents, monkeypatch):
    """Every window of a long item is found, whichever part it is in; nothing is built on the driver."""
    words = [f"w{n}" for n in range(60)]
    docs = [(n, " ".join(["x", *words[n : n + 10], "y"])) for n in range(51)] + [(99, " ".join(words)), (100, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    items = [(1, " ".join(words)), (2, "short one")]
    whole = found(spark, documents, docs, items)
    assert all(whole[n] == (12, [(1, 11)], ["1"]) for n in range(51)) and whole[99] == (60, [(0, 60)], ["1"])
    monkeypatch.setattr(decontam.automata, "__defaults__", (10, 13))
    assert found(spark, documents, docs, items) == whole


def test_repeated_documents_very_long_ones_and_clashing_columns(spark, documents, monkeypatch):
    docs = [(1, PASSAGE), (1, PASSAGE), (1, f"other {PASSAGE}"), (2, "a " * 60_000 + PASSAGE), (None, PASSAGE)]
    items = [(7, PASSAGE), (8, " ".join(f"q{n}" for n in range(12)))]
    for bound in (1000, 12):
        monkeypatch.setattr(decontam.automata, "__defaults__", (10, bound))
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        rows = decontam.find_contamination(documents(docs), benchmark).collect()
        hits = sorted((r["doc_id"] or 0, r["n_words"], sum(s["end"] - s["start"] for s in r["spans"])) for r in rows)
        assert hits == [(0, 12, 12), (1, 12, 12), (1, 12, 12), (1, 13, 12), (2, 60_012, 12)]
        frame = documents(docs).withColumnsRenamed({"found": "row", "key": "cut", "size": "words", "fingerprint": "spans"})
        kept = decontam.remove_contamination(frame, benchmark)
        assert kept.columns == frame.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_no_benchmark_and_no_documents(spark, documents):
    assert found(spark, documents, [(1, "a b")], []) == {1: (2, [], [])}
    assert found(spark, documents, [], [(1, "a")]) == {}


def test_passages_are_cut_out_and_mostly_contaminated_documents_go(spark, documents):
    clean = " ".join(f"c{n}" for n in range(20))
    docs = documents([(1, f"{clean} {PASSAGE}, {clean}"), (2, PASSAGE), (3, clean), (4, None), (5, f"short item {clean}")])
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, "short item")], "item_id long, text string")
    out = decontam.remove_contamination(docs, benchmark)
    assert out.schema == docs.schema
    texts = {row["doc_id"]: (row["text"], row["n_chars"]) for row in out.collect()}
    cut = f"{clean} , {clean}"
    assert texts == {1: (cut, len(cut)), 3: (clean, len(clean)), 4: (None, None), 5: (f" {clean}", len(clean) + 1)}


def test_cutting_goes_on_until_nothing_is_left(spark):
    inner = PASSAGE.split()
    automaton = SuffixAutomaton([("1", [w.encode() for w in inner])])
    # The passage stands inside itself; taking the inner one out joins the halves of the outer one.
    text = " ".join([*inner[:6], *inner, *inner[6:], "end"])
    cleaned, words, removed = decontam.clean_text(text, automaton)
    assert cleaned.split() == ["end"] and (words, removed) == (25, 24)


def test_removal_with_shards_is_what_one_automaton_removes(spark, documents, monkeypatch):
    """Item B holds item A; C comes together only when an A inside it is cut; the last text is mostly B."""
    inner, outer = [f"p{n}" for n in range(12)], [f"q{n}" for n in range(6)]
    b = " ".join([*outer, *inner, *(f"r{n}" for n in range(6))])
    c = [f"c{n}" for n in range(14)]
    filler = " ".join(f"f{n}" for n in range(40))
    items = [(1, " ".join(inner)), (2, b), (3, " ".join(c)), (4, "z")]
    texts = [f"{filler} {b}", " ".join([filler, *c[:7], *inner, *c[7:]]), f"z {filler}", filler, f"{b} x1 x2 x3 x4"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def removed():
        out = decontam.remove_contamination(documents(list(enumerate(texts))), benchmark)
        return {row["doc_id"]: (row["text"].split(), row["n_chars"] == len(row["text"])) for row in out.collect()}

    whole = removed()
    assert whole == {n: (filler.split(), True) for n in range(4)}
    for words in (1, 12, 30):
        monkeypatch.setattr(decontam.automata, "__defaults__", (10, words))
        assert len(decontam.automata(benchmark)) > 1 and removed() == whole


def test_hit_words(spark):
    row = spark.sql("SELECT array(struct(1L AS start, 3L AS end), struct(5L AS start, 6L AS end)) AS spans")
    assert row.select(decontam.hit_words(F.col("spans"))).first()[0] == 3
