"""Language id, token counts, quality, toxicity: against brute force, and on cases made to be told apart."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import models

from tests.llm.conftest import rows_of
from tripline.llm import language, quality, token_counts, toxicity

# --- language


def brute_ngrams(text):
    counts, word = Counter(), ""
    for char in text.lower() + " ":
        if char.isalpha():
            word += char
        elif word:
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return counts


def unpack(code):
    code, out = int(code), ""
    while code:
        out, code = out + chr(code & 0x1FFFFF), code >> 21
    return out


@pytest.mark.parametrize("chunk", [language._CHUNK, 9])
@pytest.mark.parametrize("text", ["Hello, wörld a1b  x", "é", " a ", "日本語 テスト", "x" * 50 + " yz" * 40 + "!"])
def test_ngrams(monkeypatch, text, chunk):
    monkeypatch.setattr(language, "_CHUNK", chunk)
    grams, counts = language.ngram_counts(text)
    assert {unpack(g): int(n) for g, n in zip(grams, counts)} == brute_ngrams(text)


def test_distance_is_out_of_place():
    profiles = language.Profiles.from_ordered(
        {"a": np.array([5, 7, 9], dtype=np.uint64), "b": np.array([9, 5], dtype=np.uint64)}, 3
    )
    assert profiles.distances(np.array([9, 5, 1], dtype=np.uint64)).tolist() == [2 + 1 + 3, 0 + 0 + 3]


def test_languages_are_told_apart(spark, documents):
    en, de = "the quick brown fox jumps over the lazy dog", "der schnelle braune fuchs springt über den faulen hund"
    docs = documents([(1, en, "en"), (2, de, "de"), (3, None, "de"), (4, "…1", None), (5, "", "en"), (6, "the dog", None),
                      (None, "der hund", None), (6, "the dog", None)])
    profiles = language.learn_profiles(docs)
    found = language.identify(docs, profiles).collect()
    assert sorted(((r["doc_id"], r["lang_pred"]) for r in found), key=repr) == sorted(
        [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "de")], key=repr
    )
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = language.learn_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), profiles).count() == 0


# --- token counts

SCORES = token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_are_those_of_the_best_segmentation():
    unigram = models.Unigram([("<unk>", 0.0), *SCORES.items()], 0, False)
    state = random.Random(4)
    letters = "etaoinsrhldcumfpgwybvkxjqzETAOIN.,-'éüñ12"
    pretokens = list({"▁" + "".join(state.choice(letters) for _ in range(state.randint(1, 14))) for _ in range(4000)})
    counted = token_counts.TrieCounter(SCORES).count(pretokens)
    assert counted == [len(unigram.tokenize(pretoken)) for pretoken in pretokens]


def test_unknown_characters_count_their_bytes_and_ties_take_fewer_pieces():
    counter = token_counts.TrieCounter({"▁": -1.0, "a": -1.0, "aa": -2.0})
    assert counter.count(["▁a😀", "▁aa", "▁"]) == [6, 2, 1]


def test_token_counts_of_texts(documents, monkeypatch):
    docs = documents([(1, "Hello  hello\nworld"), (2, None), (3, ""), (1, "Hello  hello\nworld"), (None, "x " * 5000)])
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = token_counts.TrieCounter(SCORES).count(["▁Hello", "▁hello", "▁world", "▁x"])
    assert rows_of(token_counts.count_tokens(docs, path), "doc_id", "n_words", "n_tokens") == sorted(
        [(1, 3, sum(one[:3])), (1, 3, sum(one[:3])), (2, 0, 0), (3, 0, 0), (None, 5000, 5000 * one[3])], key=repr
    )
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


# --- quality and toxicity


def written(spark, documents, bad):
    state = random.Random(6)
    rows, labels = [], []
    for n in range(400):
        words = [state.choice(["the", "of", "and", "river", "stone", "house", "tree"]) for _ in range(state.randint(5, 60))]
        label = n % 4 == 0
        rows.append((n, " ".join(bad(state, word) if label and k % 3 == 0 else word for k, word in enumerate(words))))
        labels.append((n, 1 - label, int(label)))
    rows += [(1000, None), (1001, ""), (None, "the river")]
    labels += [(3, None, None), (None, 0, 1), (1, 1, 0), (5000, 0, 1)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_scores(spark, documents):
    docs, labels = written(spark, documents, lambda state, word: f"{word}!!! ###")
    model = quality.learn(docs, labels.where(F.coalesce(F.col("doc_id"), F.lit(0)) < 300))
    found = docs.select("doc_id", quality.score(model, spark).alias("score")).collect()
    assert len(found) == 403 and all(0 <= r["score"] <= 1 for r in found)
    held_out = {r["doc_id"]: r["score"] for r in found if 300 <= (r["doc_id"] or 0) < 400}
    assert all((score >= quality.THRESHOLD) == (doc_id % 4 != 0) for doc_id, score in held_out.items())
    again = quality.learn(docs.repartition(5), labels.where(F.coalesce(F.col("doc_id"), F.lit(0)) < 300))
    other = {r["doc_id"]: r["score"] for r in docs.select("doc_id", quality.score(again, spark).alias("score")).collect()}
    assert all(abs(other[r["doc_id"]] - r["score"]) < 1e-6 for r in found)


def test_pairs_of_neighbours_are_counted_once_each(spark, documents):
    places, signs = quality.index_vectors()
    rows = {token: quality.row_of(token) for token in "abc"}
    vectors = quality.learn_vectors(documents([(1, "a b c"), (2, "b"), (3, None)]))
    for token, neighbours in (("a", "bc"), ("b", "ac"), ("c", "ab"), ("alone", ["alone"])):
        total = np.zeros(quality.DIMENSIONS)
        for other in neighbours:
            row = quality.row_of(other)
            total[places[row]] += signs[row]
        row = rows.get(token, quality.row_of(token))
        assert np.allclose(vectors[row], total / np.linalg.norm(total), atol=0.51 / quality._STEPS)


def brute_tokens(text):
    """One token after the other."""
    out, previous = [], ""
    for token in re.findall(r"\n|[^\W_]+|[^\w\s]+|_+", text or ""):
        if token == "\n":
            out.append("<line>")
            continue
        low = "".join(map(quality.lower, token))
        if len(token) > 1 and token.isupper():
            out.append("<upper>")
        if low == previous and low[0].isalnum():
            out.append("<same>")
        if low[0].isalnum():
            previous = low
        out.append(low)
    return out


def cut_tokens(texts):
    found = [[] for _ in texts]
    for cut in quality.cut(pa.array(texts, pa.string())):
        for text, a, b in zip(cut.texts, cut.begins, cut.begins[1:]):
            found[text] += zip(cut.rows[a:b].tolist(), cut.kinds[a:b].tolist())
    return found


def kind_of(token):
    kind = "digits" if token.isdigit() else "word" if token[0].isalnum() else "marks"
    return quality.KINDS.index(f"<{kind}{sum(len(token) > limit for limit in (3, 6, 10))}>")


def expected_tokens(text):
    signs = quality.SIGNS
    return [(signs.index(t), signs.index(t)) if t in signs else (quality.row_of(t), kind_of(t)) for t in brute_tokens(text)]


def odd_texts(count):
    state = random.Random(8)
    parts = ["The", "THE", "the", " ", "\n", "\t", "__", "_", "!!", "#", "é", "É", "日本", "42", "a1", "\x1c", "\xa0", "ß", "İ", "ǅ", "Σ", "²", "x" * 12, "😀"]
    return ["".join(state.choices(parts, k=state.randint(0, 30))) for _ in range(count)]


def test_tokens_and_their_signs(monkeypatch):
    texts = ["The THE\nx!! ", None, "", *odd_texts(500)]
    assert brute_tokens(texts[0]) == ["the", "<upper>", "<same>", "the", "<line>", "x", "!!"]
    assert cut_tokens(texts) == list(map(expected_tokens, texts))
    monkeypatch.setattr(quality, "_SLICE_BYTES", 50)
    texts = [" ".join(odd_texts(40)), "same same " * 60, "x", "one " * 30]
    assert cut_tokens(texts) == list(map(expected_tokens, texts))


def test_neighbours_across_the_parts_of_a_long_text(monkeypatch):
    texts = pa.array(["a b c d e f g h " * 40, "x y z", " ".join(odd_texts(30))])

    def sums():
        found = quality._Contexts()
        for cut in quality.cut(texts):
            found.add(cut)
        return found.sums

    whole = sums()
    monkeypatch.setattr(quality, "_SLICE_BYTES", 40)
    assert (sums() == whole).all()


def test_temperature_calibrates():
    state = np.random.default_rng(1)
    logits = state.normal(0, 2, 4000)
    y = (state.random(4000) < quality._sigmoid(logits)).astype(float)
    assert 0.85 < quality.calibrated_temperature(logits, y) < 1.18
    assert 2.5 < quality.calibrated_temperature(3 * logits, y) < 3.5


@pytest.mark.parametrize("keep", ["quality = 1", "quality = 0", "false"])
def test_quality_with_one_kind_of_label(spark, documents, keep):
    docs, labels = written(spark, documents, lambda state, word: word)
    model = quality.learn(docs.limit(50), labels.where(keep))
    scores = {r[0] for r in docs.select(quality.score(model, spark)).collect()}
    assert scores == {{"quality = 1": 1.0, "quality = 0": 0.0, "false": 0.5}[keep]}


INSULTS = ["scum", "clown", "idiotisch", "idiotenhaft", "idiotie"]


def test_toxicity(spark, documents):
    docs, labels = written(spark, documents, lambda state, word: state.choice(INSULTS))
    model = toxicity.learn(docs, labels.where(F.coalesce(F.col("doc_id"), F.lit(0)) < 300))
    assert (np.diff(model.thresholds) > 0).all()
    rows = docs.select("doc_id", toxicity.severity(model, spark).alias("s")).select("doc_id", "s.*").collect()
    assert len(rows) == 403
    for row in rows:
        assert 0 <= row["severity"] <= toxicity.GRADES - 1
        if row["doc_id"] is not None:
            assert row["toxic"] == (300 > row["doc_id"] or row["doc_id"] < 400) * (row["doc_id"] % 4 == 0 and row["doc_id"] < 400)
    by_grade = {}
    for row in rows:
        by_grade.setdefault(row["grade"], []).append(row["severity"])
    means = [np.mean(by_grade[g]) for g in sorted(by_grade)]
    assert means == sorted(means) and len(means) > 2


def test_ordinal_fit_recovers_order():
    state = np.random.default_rng(3)
    rows = [sorted(set(state.integers(0, 20, 6).tolist())) for _ in range(3000)]
    truth = np.linspace(-2, 2, 20)
    sums = np.array([truth[row].sum() for row in rows]) + state.logistic(0, 1, 3000)
    grades = np.searchsorted([0.0, 2.0, 4.0], sums)
    weights, thresholds = toxicity.fit(rows, grades, 20)
    assert np.corrcoef(weights, truth)[0, 1] > 0.98
    assert np.allclose(thresholds, [0, 2, 4], atol=0.6)


@pytest.mark.parametrize("keep, severity", [("toxic = 1", 1.0), ("toxic = 0", 0.0), ("false", 0.0)])
def test_toxicity_with_one_kind_of_label(spark, documents, keep, severity):
    docs, labels = written(spark, documents, lambda state, word: word)
    model = toxicity.learn(docs.limit(50), labels.where(keep))
    found = docs.select(toxicity.severity(model, spark).alias("s")).select("s.severity").collect()
    assert {round(r[0], 6) for r in found} == {severity}


def test_scoring_no_rows(spark, documents):
    docs, labels = written(spark, documents, lambda state, word: f"{word}!!!")
    none = docs.limit(0)
    assert none.select(quality.score(quality.learn(none, labels), spark)).count() == 0
    assert none.select(toxicity.severity(toxicity.learn(none, labels), spark)).count() == 0
