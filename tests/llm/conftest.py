from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tripline.operators.workdir import WorkDir

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def work(spark, tmp_path):
    with WorkDir(spark, str(tmp_path)) as folder:
        yield folder
    assert not list(tmp_path.iterdir())


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]); one more column has a name operators use inside."""

    def build(rows):
        schema = T._parse_datatype_string(DOCUMENTS + ", fingerprint string, size string, found string, key string")
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), "f", "s", "x", "k"))
        return spark.createDataFrame(full, schema)

    return build


def rows_of(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
