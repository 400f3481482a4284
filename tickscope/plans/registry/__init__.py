"""Registered queries, one per operator id, each with its SQL equivalent where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def stable_sql(sql: str) -> str:
    """round(x, n) -> decimal rounding of x cut to nine digits, the twin of ``stable_round``."""
    out, i = "", 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return out + sql[i:]
        depth, k, comma = 1, j + 6, None
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = stable_sql(sql[j + 6:comma]), sql[comma + 1:k - 1].strip()
        out += sql[i:j] + f"CAST(round(CAST({inner} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"
        i = k


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = stable_sql(sql)
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tickscope.plans.registry import detectors, learning, relational, scalar, storage  # noqa: F401

    return QUERIES, ORACLE
