"""Domain tables derived from the given ones by integer rules, for Spark and (as CTEs) for the SQL twins.

Each table is one base table and select expressions in the common part of both dialects.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footfall.session import table

TABLES: dict[str, tuple[str, list[str]]] = {
    "facilities": (
        "customer",
        [
            "c_custkey AS id", "c_name AS name", "c_mktsegment AS category", "c_acctbal AS balance", "c_nationkey AS area_id",
            "(c_custkey * 7919) % 4001 - 2000 AS x", "(c_custkey * 104729) % 3989 - 1994 AS y",
        ],
    ),
    "demand": (
        "orders",
        [
            "o_orderkey AS id", "o_custkey AS owner", "o_totalprice AS price", "(o_orderkey * 6007) % 4001 - 2000 AS x", "(o_orderkey * 9973) % 3989 - 1994 AS y",
            "CAST(floor(((o_orderkey * 6007) % 4001 - 2000) / 50.0) AS BIGINT) AS ix", "CAST(floor(((o_orderkey * 9973) % 3989 - 1994) / 50.0) AS BIGINT) AS iy",
        ],
    ),
    "nodes": (
        "part",
        [
            "p_partkey AS id", "p_partkey % 50 AS gx", "CAST(floor(p_partkey / 50) AS BIGINT) AS gy", "60 * (p_partkey % 50) AS x", "60 * CAST(floor(p_partkey / 50) AS BIGINT) AS y",
            "CASE p_size % 10 WHEN 0 THEN 'gate' WHEN 1 THEN 'wall' WHEN 2 THEN 'fence' WHEN 3 THEN 'bollard' WHEN 4 THEN 'lift_gate' END AS barrier",
            "p_size AS size", "p_brand AS brand",
        ],
    ),
    "poi_rows": (
        "lineitem JOIN part ON p_partkey = l_partkey",
        [
            "CAST(l_partkey AS VARCHAR(20)) AS uid", "l_suppkey AS seq", "l_linenumber AS page", "p_type AS tag", "p_name AS name", "l_orderkey AS ord",
            "(l_partkey * 7919) % 4001 - 2000 AS x", "(l_partkey * 104729) % 3989 - 1994 AS y",
        ],
    ),
    "routes": (
        "lineitem",
        [
            "l_orderkey AS origin", "l_suppkey AS facility", "l_linenumber AS line", "CAST(l_quantity * 40 AS DOUBLE) AS distance_m",
            "CAST(floor(l_extendedprice) AS BIGINT) % 1800 AS duration", "CAST(l_tax * 1000 AS DOUBLE) AS origin_offset", "CAST(l_discount * 1000 AS DOUBLE) AS destination_offset",
            "CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'timeout' ELSE 'rate_limit' END AS reason", "l_linestatus = 'O' AS endpoint_verified",
        ],
    ),
    "cases": (
        "lineitem",
        [
            "l_orderkey AS ord", "l_linenumber AS line", "l_returnflag AS stratum", "l_linestatus = 'O' AS prediction", "l_shipdate AS day",
            "CAST(floor(l_extendedprice) AS BIGINT) % 1800 AS duration",
            "CASE WHEN l_discount <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) % 1800 <= 900 END AS truth",
        ],
    ),
    "ray_samples": (
        "orders",
        ["o_custkey % 16 AS angle", "o_orderkey % 1600 AS radius", "o_totalprice < 250000 AS label", "o_orderkey AS ord"],
    ),
    "dispatch_log": (
        "events",
        [
            "event_id", "CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS start_ms", "CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) + CAST(floor(value * 1000) AS BIGINT) AS end_ms", "event_type AS outcome",
            "event_id % 2 AS service", "user_id", "value",
        ],
    ),
    "tasks": (
        "orders",
        ["o_orderkey AS task", "o_custkey AS session", "o_orderstatus AS status", "o_orderdate AS day", "o_orderpriority AS priority", "o_totalprice AS bytes"],
    ),
    "revisions": (
        "lineitem",
        ["l_orderkey AS task", "l_linenumber AS revision", "l_partkey AS part", "l_suppkey AS supp", "l_quantity AS quantity", "l_extendedprice AS price", "l_returnflag AS stage", "l_shipdate AS day"],
    ),
}


def demo(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    base, columns = TABLES[name]
    left, *right = re.split(r" JOIN | ON ", base)
    rows = table(spark, sf_dir, left)
    if right:
        on = [c.strip() for c in right[1].split("=")]
        other = table(spark, sf_dir, right[0])
        rows = rows.join(other, rows[on[1]] == other[on[0]])
    return rows.selectExpr(*[c.replace("epoch_us(ts)", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") for c in columns])


def ctes(*names: str) -> str:
    """The same tables as the head of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in names)


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and SQL twins of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Registers the decorated function under ``name``; ``tables`` are the demo tables its SQL reads."""

        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                head = ctes(*tables) if tables else ""
                body = sql.strip()
                if head and body.startswith("WITH RECURSIVE "):
                    head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), ",\n" + body[15:]
                elif head and body.startswith("WITH "):
                    body = ",\n" + body[5:]
                self.sql[name] = f"{head}\n{body}" if head else body
            return query

        return put

    def twin(self, name: str, tables: tuple[str, ...], sql: str) -> Callable[[Query], Query]:
        """Registers the decorated function, whose plan is its own, beside an SQL text that names demo tables in braces."""
        sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)  # doubles, not decimals
        return self.add(name, _as_bigint(re.sub(r"\{(\w+)\}", r"\1", sql)), tables)


def _as_bigint(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``: the former is wider than a long in DuckDB."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql
