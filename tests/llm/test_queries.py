"""The registered queries: against SQL or brute force on the smallest tables, and without the package."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import differences, oracle_connection
from tests.conftest import SF_DIR
from tests.llm.test_alignment import brute as brute_alignment
from tests.llm.test_decontam import brute
from tests.llm.test_mixing import brute_targets
from tests.llm.test_rules import brute as brute_statistics
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tripline.llm import token_counts
from tripline.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


def run(spark, name):
    return {row["doc_id"]: row for row in contract.queries()[name](spark, SF_DIR).collect()}


def test_one_query_for_each_operator_and_the_pipeline():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    _, problem = differences(contract.queries()[name](spark, SF_DIR), oracle_connection(SF_DIR), ORACLES[name])
    assert problem == ""


def test_languages_of_documents_that_were_held_out(spark, docs):
    found = run(spark, "op1_language_id")
    assert found.keys() == {d["doc_id"] for d in docs}
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert all(found[d["doc_id"]]["held_out"] for d in held)
    assert np.mean([found[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.95


def best_count(word, scores, unknown):
    """Tokens of the best segmentation of one word, over all of its substrings."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        letter, options = word[end - 1], []
        if letter not in scores:
            options.append((best[-1][0] + unknown, -best[-1][1] - len(letter.encode())))
        for start in range(max(0, end - 16), end):
            score = scores.get(word[start:end])
            if score is not None:
                options.append((best[start][0] + score, -best[start][1] - 1))
        value, tokens = max(options)
        best.append((value, -tokens))
    return best[-1][1]


def test_token_counts_of_whole_texts(spark, docs):
    scores = token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, scores)) <= 16
    unknown, seen = min(scores.values()) - token_counts.UNKNOWN_PENALTY, {}
    found = run(spark, "op3_token_counts")
    for doc in docs:
        split = WORDS.findall(doc["text"] or "")
        for word in split:
            if word not in seen:
                seen[word] = best_count("▁" + word, scores, unknown)
        assert tuple(found[doc["doc_id"]]) == (doc["doc_id"], len(split), sum(map(seen.__getitem__, split)))


def test_token_files_in_order(spark, docs):
    found, at = run(spark, "op4_token_files"), 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert tuple(found[doc["doc_id"]])[1:] == (at, len(ids), crc)
        at += len(ids)


def test_quality_of_documents_that_were_held_out(spark):
    found = run(spark, "op5_quality_classifier")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(found[d]["held_out"] and found[d]["predicted"] == (found[d]["score"] >= 0.7) for d in held)
    assert np.mean([found[d]["predicted"] == labels[d] for d in held]) >= 0.8


def test_rules_on_whole_texts(spark, docs):
    found = run(spark, "op6_quality_rules")
    for doc in docs:
        row, base = found[doc["doc_id"]], brute_statistics(doc["text"])
        assert tuple(row[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_toxic_documents(spark):
    found = run(spark, "op7_toxicity")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    assert np.mean([found[d]["toxic"] == bool(toxic) for d, toxic in labels.items()]) >= 0.95


def test_near_duplicates(spark, docs):
    found = run(spark, "op8_simhash_near_dedup")
    docs = sorted(docs, key=lambda d: d["doc_id"])
    fingerprints = [brute_fingerprint(d["text"]) for d in docs]
    for doc, value, first in zip(docs, fingerprints, brute_components(fingerprints)):
        assert tuple(found[doc["doc_id"]]) == (doc["doc_id"], f"{value:016x}", docs[first]["doc_id"])


def sizes_by_source(docs):
    sizes = {}
    for doc in docs:
        sizes[doc["source"]] = sizes.get(doc["source"], 0) + len(WORDS.findall(doc["text"] or ""))
    return sizes


def test_mix(spark, docs):
    found = run(spark, "op9_source_mixing")
    sizes, taken = sizes_by_source(docs), {}
    targets = brute_targets(sizes)
    for doc in docs:
        row = found[doc["doc_id"]]
        assert row["size"] == len(WORDS.findall(doc["text"] or "")) and row["source_size"] == sizes[doc["source"]]
        assert row["target"] == pytest.approx(targets[doc["source"]]) and row["taken"] <= 2 * row["size"]
        taken[doc["source"]] = taken.get(doc["source"], 0) + row["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(0.05 * targets[s], 100) for s in sizes)


def test_bpe_ids_and_decoded_texts(spark, docs):
    found = run(spark, "op11_bpe_codec")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for doc in docs:
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(found[doc["doc_id"]]) == (doc["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(decoded))


def test_alignment_of_whole_texts(spark, docs):
    found = run(spark, "op13_token_alignment")
    assert {d["doc_id"]: tuple(found[d["doc_id"]])[1:] for d in docs} == dict(
        zip((d["doc_id"] for d in docs), brute_alignment([d["text"] for d in docs]))
    )


def test_pipeline_stages_against_brute_force(spark, docs, work):
    """Each stage on what its predecessor kept."""
    before = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = before.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = work.store(stage(spark, before, SF_DIR), name)
        assert before.columns == columns
        kept[name] = [row.asDict() for row in before.collect()]
    by_id = {d["doc_id"]: d for d in docs}

    judged = run(spark, "op6_quality_rules")
    assert sorted(d["doc_id"] for d in kept["quality_rules"]) == sorted(i for i, r in judged.items() if r["kept"])

    left = sorted(kept["quality_rules"], key=lambda d: d["doc_id"])
    groups = brute_components([brute_fingerprint(d["text"]) for d in left])
    assert sorted(d["doc_id"] for d in kept["near_dedup"]) == [left[g]["doc_id"] for g in sorted(set(groups))]

    split = lambda text: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    items = [(r["item_id"], split(r["text"])) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    hits = {d["doc_id"]: brute(items, split(d["text"]), 10)[0] for d in kept["near_dedup"]}
    clean = {d["doc_id"]: d["text"] for d in kept["decontamination"]}
    for doc_id, hit in hits.items():
        whole = split(by_id[doc_id]["text"])
        if 2 * len(hit) > len(whole):
            assert doc_id not in clean
        else:
            assert split(clean[doc_id]) == [w for n, w in enumerate(whole) if n not in hit]
            assert hit or clean[doc_id] == by_id[doc_id]["text"]

    mixed = {}
    for doc in kept["mixing"]:
        mixed[doc["source"]] = mixed.get(doc["source"], 0) + len(WORDS.findall(doc["text"]))
    targets = brute_targets(sizes_by_source(kept["decontamination"]))
    # These sources have a handful of documents, which are taken whole.
    largest = {}
    for doc in kept["decontamination"]:
        largest[doc["source"]] = max(largest.get(doc["source"], 0), len(WORDS.findall(doc["text"])))
    assert all(abs(mixed.get(s, 0) - target) <= largest[s] for s, target in targets.items())

    rows = contract.queries()["pipeline"](spark, SF_DIR).collect()
    assert len(rows) == len(kept["mixing"])
    assert hashlib.sha256(repr(sorted(r["doc_id"] for r in rows)).encode()).digest() == hashlib.sha256(
        repr(sorted(d["doc_id"] for d in kept["mixing"])).encode()
    ).digest()


def test_the_rest_works_without_this_package(tmp_path):
    """A copy without the folders and the pipeline still gives the other queries."""
    root = Path(__file__).resolve().parents[2]
    for name in ("tripline", "checks", "__spark_entry__.py"):
        source = root / name
        for path in [source] if source.is_file() else source.rglob("*.py"):
            if "llm" not in path.relative_to(root).parts:
                target = tmp_path / path.relative_to(root)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
