from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.operators.workdir import WorkDir
from tripline.session import local_session
from tripline.sources import DOCUMENT_COLUMNS, SCHEMAS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a source from partial rows: absent columns are NULL, documents are dicts, times are text."""

    def build(name: str, rows: list[dict]):
        schema = SCHEMAS[name]
        for row in rows:
            unknown = set(row) - set(schema.fieldNames())
            assert not unknown, unknown
        documents = DOCUMENT_COLUMNS[name]
        plain = T.StructType(
            [
                T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.VariantType, T.TimestampNTZType)) else f.dataType)
                for f in schema.fields
            ]
        )
        values = [
            tuple(
                json.dumps(row[f]) if f in documents and row.get(f) is not None else row.get(f)
                for f in schema.fieldNames()
            )
            for row in rows
        ]
        df = spark.createDataFrame(values, plain)
        times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        df = df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in times})
        if documents:
            df = df.withColumns({name: F.parse_json(name) for name in documents})
        return df

    return build


@pytest.fixture
def work(spark, tmp_path):
    """A work folder; nothing of it is left when its handle closes."""
    folder = tmp_path / "work"
    folder.mkdir()
    with WorkDir(spark, str(folder)) as handle:
        yield handle
    assert not list(folder.iterdir())


@pytest.fixture
def eager_skew_join(spark):
    """Settings that make small tables count as skewed and nothing as broadcastable."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    """Physical plan after execution, with adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
