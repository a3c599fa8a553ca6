"""What several operators share: words, hash remainders, names that cannot clash."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that exist only inside an operator.
INNER = "__tl_"

#: Rows that pass to a Python worker at a time; texts are long.
BATCH_ROWS = 1_000
#: Where memory is scarce: bytes of a batch after which no row joins it, and rows that a file reader holds as columns.
BATCH_BYTES = 1 << 20
READ_ROWS = 256


def bounded_batches(job: Callable) -> Callable:
    """Lets a job that takes the session first hand at most ``BATCH_ROWS`` texts at a time to Python workers."""

    @wraps(job)
    def run(spark: SparkSession, *rest):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return job(spark, *rest)

    return run


def lean_batches(job: Callable) -> Callable:
    """``bounded_batches`` that also bounds a batch in bytes, and what a reader of Parquet holds of long texts.

    4,096 long texts or a few token blocks at a time are arrays of 16 MB and more, in the heap and
    beside it; a heap in pieces grows for each of them and is not given back.
    """

    @wraps(job)
    def run(spark: SparkSession, *rest):
        if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
            spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
        return bounded_batches(job)(spark, *rest)

    return run


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def lower_ascii_words(text: str | None) -> list[bytes]:
    """The same runs with A to Z in lower case; other letters keep their case."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_count(text: Column | str) -> Column:
    """Number of those runs as a Spark expression; 0 for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; 0 for a NULL id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id`` and ``label`` of about ``max_rows`` labelled ids at most, picked by hash; the same in every run.

    Rows with a NULL id or label are left out; of rows that repeat an id the
    smallest label counts. The result is small enough to broadcast.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min(label).alias(label))
    total = marked.count()
    share = min(1.0, max_rows / max(total, 1))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    return F.broadcast(marked.where(picked))
