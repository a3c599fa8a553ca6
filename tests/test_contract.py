"""The driver contract: every query equals its oracle on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from checks import jobs, operators, streams
from checks.compare import differences, oracle_connection
from tests.conftest import SF_DIR
from tripline.sources import SCHEMAS, conform, load_source


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


OWN = {**jobs.QUERIES, **operators.QUERIES, **streams.QUERIES}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_oracle(spark, connection, name):
    _, problem = differences(contract.queries()[name](spark, SF_DIR), connection, contract.oracle_sql()[name])
    assert problem == ""


def test_every_query_has_an_oracle():
    assert OWN.keys() <= contract.queries().keys() and OWN.keys() <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_load_source_parses_text_and_checks_columns(spark, table, tmp_path):
    rows = [{"event_time": "2024-01-01 00:00:00", "resource": {"labels": {"unique_id": "1"}}}]
    stored = table("gcp_audit", rows).withColumn("resource", F.to_json("resource")).withColumn("more", F.lit(1))
    stored = stored.withColumn("event_date", F.to_date("event_time"))
    stored.write.parquet(str(tmp_path / "log"))
    loaded = load_source(spark, "gcp_audit", str(tmp_path / "log"))
    assert isinstance(loaded.schema["resource"].dataType, T.VariantType)
    assert loaded.columns == SCHEMAS["gcp_audit"].fieldNames()
    assert loaded.select(F.variant_get("resource", "$.labels.unique_id", "string")).first()[0] == "1"
    with pytest.raises(ValueError, match="project_id"):
        conform(loaded.drop("project_id"), "gcp_audit")
