"""Registry of queries and of the SQL statements that check them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.plans.oracle_views import ORACLE_VIEWS
from tallyweave.sources.driver_views import VIEWS, DriverTables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}
#: Check statements as written, for statements that build on others.
BODIES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Types both engines print alike: dates and timestamps as text, decimals as double, counts as long."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def oracle_text(body: str) -> str:
    """The statement with every view it uses, table names filled in."""
    statement = with_views(body, {**VIEWS, **ORACLE_VIEWS})
    return re.sub(r"\{(\w+)\}", r"\1", statement)


def query(name: str, sql: str | None = None):
    """Register a function of the driver tables under the operator's name."""

    def register(function: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(function(DriverTables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        MODULES[name] = function.__module__.rpartition(".")[2]
        if sql is not None:
            BODIES[name], ORACLES[name] = sql, oracle_text(sql)
        return function

    return register
