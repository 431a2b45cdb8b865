"""Registered queries over the given tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixtures, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
KINDS = {"l": ("long", "BIGINT"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN"), "d": ("double", "DOUBLE")}


def _columns(schema: str) -> list[tuple[str, str]]:
    """'l:a,b d:c' as (name, kind) pairs."""
    return [(n, part[0]) for part in schema.split() for n in part[2:].split(",")]


def query(name: str, schema: str, sql: str | None = None, digits: int = 6):
    """Registers a function of the fixtures; both sides are cast to ``schema`` and doubles rounded alike."""

    def keep(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Fixtures(spark, sf_dir))
            return df.select(*((F.floor(F.col(n).cast("double") * 10.0**digits + 0.5) / 10.0**digits if k == "d" else F.col(n).cast(KINDS[k][0])).alias(n) for n, k in _columns(schema)))

        _QUERIES[name] = run
        if sql:
            cast = ", ".join(f'floor(CAST("{n}" AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits} AS "{n}"' if k == "d" else f'CAST("{n}" AS {KINDS[k][1]}) AS "{n}"' for n, k in _columns(schema))
            _SQL[name] = f"SELECT {cast} FROM ({with_views(sql)}) result"
        return build

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["slice_wall_structure"](spark, sf_dir)


def _load() -> None:
    from . import geometry_queries, mesh_queries, measure_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
