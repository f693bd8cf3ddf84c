"""Registry of named queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelens.sources.tables import SQL_VIEWS, VIEWS, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RAW = "region nation customer supplier part orders lineitem events labels documents".split()


def _used(sql: str) -> set[str]:
    return {n for n in [*VIEWS, *_RAW] if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}


def duck(sql: str) -> str:
    """DuckDB SQL with the derived tables it uses in front."""
    need = [n for n in SQL_VIEWS if n in _used(sql)]
    if not need:
        return sql
    heads = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"


def both(name: str, sql: str, oracle: str | None = None) -> None:
    """A query in SQL that Spark runs; oracle where DuckDB's dialect differs."""

    used = sorted(_used(sql))
    # tables are handed over by argument, so no view of the session is replaced
    text = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", sql.replace("{", "{{").replace("}", "}}")) if used else sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: VIEWS[n](spark, sf_dir) if n in VIEWS else load(spark, sf_dir, n) for n in used}) if used else spark.sql(sql)

    QUERIES[name] = run
    ORACLES[name] = duck(oracle or sql)


def query(sql: str | None = None):
    """Decorator: a function of (spark, sf_dir), and DuckDB SQL for it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return keep
