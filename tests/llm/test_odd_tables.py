"""Empty tables, repeated ids and very long texts through the pipeline and the learned operators."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.conftest import DOCUMENTS
from tripline.llm import chat, common, language, quality, rules, token_files, toxicity

LONG = "word and the other of river " * 40_000


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_the_pipeline_without_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables(spark.createDataFrame([], DOCUMENTS))).count() == 0


def test_the_pipeline_with_repeated_ids_nulls_and_a_long_text(spark, tables):
    """Ids that repeat with different texts lose no text but copies; NULLs and empty texts do no harm."""
    clean = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars between 1500 and 4000").limit(30).collect()]
    rows = [(n // 3, text, None, "a", len(text)) for n, text in enumerate(clean)]
    rows += [(0, clean[0], None, "a", 1), (None, None, None, None, None), (None, "", None, None, 0), (77, LONG, None, "b", len(LONG))]
    folder = tables(spark.createDataFrame(rows, DOCUMENTS))
    kept = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept[name] = [(r["doc_id"], r["text"]) for r in stage(spark, docs, folder).collect()]
        docs = spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in kept[name]], DOCUMENTS)
    passed = {text for _, text in kept["quality_rules"] if text}
    assert len(kept["near_dedup"]) == len(set(kept["near_dedup"])) <= len(passed) + 1
    assert {text for _, text in kept["near_dedup"]} <= passed | {None, ""}
    assert len({text for _, text in kept["near_dedup"]}) == len(kept["near_dedup"])


def test_the_pipeline_passes_few_bytes_at_a_time_however_long_texts_are(spark, tmp_path, monkeypatch):
    real, folder = token_files._raw_blocks, str(tmp_path)

    def spying(*given):
        run = real(*given)

        def spied(batches):
            def seen():
                for batch in batches:
                    with open(f"{folder}/{uuid4().hex}", "w") as file:
                        file.write(str(batch.nbytes))
                    yield batch

            yield from run(seen())

        return spied

    monkeypatch.setattr(token_files, "_raw_blocks", spying)
    rows = [(n, f"word{n} and the other of river " * 4_000, None, "a", 1) for n in range(120)]
    found = corpus_pipeline.tokens(spark, spark.createDataFrame(rows, DOCUMENTS), folder).select("doc_id").collect()
    sizes = [int(file.read_text()) for file in tmp_path.iterdir()]
    assert sorted(r["doc_id"] for r in found) == [*range(120)] and sum(sizes) > 12_000_000
    # A batch closes with the row that brings it to the bound.
    assert max(sizes) < common.BATCH_BYTES + 300_000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= common.READ_ROWS


def test_learned_operators_read_a_very_long_text_whole(spark, documents):
    rows = [(n, f"good river stone {n} " * 12 if n % 2 else f"bad!!! scum ### {n} " * 12, "en" if n % 2 else "de") for n in range(80)]
    docs = documents([*rows, (500, LONG), (500, LONG), (501, f"{LONG} scum")])
    labels = spark.createDataFrame([(n, n % 2, 1 - n % 2) for n in range(80)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    scores = docs.where("doc_id >= 500").select(quality.score(model, spark).alias("s")).collect()
    assert len(scores) == 3 and scores[0]["s"] == scores[1]["s"] and all(0 <= r["s"] <= 1 for r in scores)
    judged = rules.judge(docs, rules.learn_rules(docs, labels)).where("doc_id = 500").collect()
    assert [r["n_words"] for r in judged] == [240_000, 240_000] and judged[0]["word_chars"] == len(LONG.replace(" ", ""))
    found = docs.where("doc_id >= 500").select("doc_id", toxicity.severity(toxicity.learn(docs, labels), spark).alias("f"))
    by_id = {r["doc_id"]: r["f"]["severity"] for r in found.collect()}
    assert by_id[501] > by_id[500]  # The one word at the end counts.
    profiles = language.learn_profiles(docs)
    predicted = docs.where("doc_id >= 500").select(language.predicted(profiles, spark).alias("f")).select("f.lang_pred")
    assert len({r[0] for r in predicted.collect()}) == 1


def test_a_very_long_turn(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "[/INST]")], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_conversations(frame, path), path).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(LONG) + 7
