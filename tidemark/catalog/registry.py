"""Named queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.values import rounded
from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dbl: str = "", digits: int = 6):
    """Register a query under its function name.

    Double columns are rounded on both sides: sums depend on row order in the
    last bits. ``dbl`` names the double columns of the SQL.
    """

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir.rstrip("/")), digits)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            cols = ", ".join(f'round(CAST("{n}" AS DOUBLE), {digits}) + 0.0 AS "{n}"' for n in dbl.split())
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql
        return fn

    return add


_RUNS: dict[tuple, object] = {}


def shared(cls, spark: SparkSession, sf_dir: str):
    """One run object per session, folder and kind.

    A run stages its signal, trade and ledger tables once and all its reports
    read them, as a scheduled job would. ``forget`` starts a new run; the
    benchmark calls it before every timed query.
    """
    key = (spark.sparkContext.applicationId, sf_dir, cls)
    if key not in _RUNS:
        _RUNS[key] = cls(spark, sf_dir)
    return _RUNS[key]


def forget() -> None:
    _RUNS.clear()
