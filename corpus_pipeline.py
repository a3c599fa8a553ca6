"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripline.llm import token_files
from tripline.llm.common import lean_batches, table
from tripline.llm.decontam import remove_contamination
from tripline.llm.mixing import mixed_documents
from tripline.llm.rules import keep_accepted, learn_rules
from tripline.llm.simhash import keep_one_per_group
from tripline.operators.workdir import WorkDir


@lean_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the decision list learned from ``labels`` reject go."""
    return keep_accepted(docs, learn_rules(docs, table(spark, sf_dir, "labels")))


@lean_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays (three words, two bits, as in ``op8``)."""
    return keep_one_per_group(docs, WorkDir.for_session(spark))


@lean_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` are cut out of texts; documents that are mostly such passages go."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


@lean_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs, WorkDir.for_session(spark))


@lean_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    import public_tokenizers

    work = WorkDir.for_session(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.digests(spark, token_files.write(docs, work.new_path("tokens"), work, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the learned rules nor the fingerprints nor the tokens.
ORACLE_SQL: str | None = None


@lean_batches
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage keeps is written and read again."""
    work = WorkDir.for_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
