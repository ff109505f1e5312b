"""All queries of the catalog, text and telemetry operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanfit.plans import etl, extras, names, pages, proof, records, search, searches, signals

FAMILIES = (search, pages, etl, signals, proof, extras, names, searches, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for family in FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.oracle().items()}
