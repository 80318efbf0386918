"""One plain view per table or view of a schema."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_RESULT = "name string, created boolean, error string"


def view_name(name: str) -> str:
    """Upper-case, with exactly one leading ``VW_``."""
    return "VW_" + name.upper().removeprefix("VW_")


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def mirror_schema(spark: SparkSession, source_schema: str, target_schema: str) -> DataFrame:
    """Create or replace the views; one that fails is reported and the rest go on."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_quoted(target_schema)}")
    done = []
    for table in spark.catalog.listTables(source_schema):
        if table.isTemporary:
            continue
        name = view_name(table.name)
        try:
            spark.sql(
                f"CREATE OR REPLACE VIEW {_quoted(target_schema, name)} AS "
                f"SELECT * FROM {_quoted(source_schema, table.name)}"
            )
            done.append((name, True, None))
        except PySparkException as error:
            done.append((name, False, str(error)))
    return spark.createDataFrame(done, _RESULT)
