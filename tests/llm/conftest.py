import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are absent")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows, columns="doc_id long, text string"):
        made = spark.createDataFrame(rows, columns).repartition(3)
        for name in ("block", "fp", "score", "pieces", "part", "bucket"):
            made = made.selectExpr("*", f"'clash' as {name}")
        return made

    return make
