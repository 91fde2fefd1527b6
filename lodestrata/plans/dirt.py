"""Tables with defects put in by key arithmetic, as one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TextTable

_S = "CAST({} AS STRING)".format
_P = "CAST(floor(o_totalprice) AS BIGINT)"
_Y, _M, _D = (_S(f"{x}(o_orderdate)") for x in ("year", "month", "day"))
_ISO = f"{_Y} || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0')"
_DMY = f"lpad({_D}, 2, '0') || '/' || lpad({_M}, 2, '0') || '/' || {_Y}"
_COMMA = f"{_S(f'CAST(floor({_P} / 1000) AS BIGINT)')} || ',' || lpad({_S(f'{_P} % 1000')}, 3, '0')"

#: table -> {column: expression}
DIRTY = {
    "orders": {
        "order_id": _S("o_orderkey"),
        "cust": f"CASE WHEN o_orderkey % 97 = 0 THEN ' ' || {_S('o_custkey')} WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 83 = 0 THEN 'X' || {_S('o_custkey')} ELSE {_S('o_custkey')} END",
        "priority": "CASE WHEN o_orderkey % 11 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 13 = 0 THEN '  ' || o_orderpriority WHEN o_orderkey % 17 = 0 THEN lower(o_orderpriority) || ' ' WHEN o_orderkey % 19 = 0 THEN 'N/A' WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END",
        "total": f"CASE WHEN o_orderkey % 29 = 0 THEN '-999' WHEN o_orderkey % 31 = 0 THEN '$' || {_S(_P)} WHEN o_orderkey % 37 = 0 THEN '(' || {_S(_P)} || '.50)' WHEN {_P} >= 1000 AND o_orderkey % 7 = 0 THEN {_COMMA} || '.25' WHEN o_orderkey % 41 = 0 THEN 'n/a' ELSE {_S(_P)} END",
        "day": f"CASE WHEN o_orderkey % 5 = 0 THEN {_ISO} ELSE {_DMY} END",
        "zip": "CASE WHEN o_orderkey % 3 = 0 THEN '0' || lpad(" + _S("o_custkey % 9999") + ", 4, '0') ELSE '1' || lpad(" + _S("o_custkey % 9999") + ", 4, '0') END",
        "note": "CASE WHEN o_orderkey % 43 = 0 THEN '=1+1' WHEN o_orderkey % 47 = 0 THEN 'Caf' || chr(195) || chr(169) WHEN o_orderkey % 53 = 0 THEN '-' || " + _S("o_custkey") + " ELSE 'note' END",
        "mail": f"CASE WHEN o_orderkey % 2 = 0 THEN 'user' || {_S('o_custkey')} || '@example.com' ELSE 'none given' END",
    },
}
_SOURCE = {"orders": "orders"}


def cte(table: str) -> str:
    """``d AS (...)`` for the oracle."""
    return f"d AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DIRTY[table].items())} FROM {_SOURCE[table]})"


def dirty(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> TextTable:
    """The dirty table, or some of its columns, in order of its key."""
    df = spark.read.parquet(f"{sf_dir}/{_SOURCE[table]}.parquet")
    own = columns or list(DIRTY[table])
    cells = [F.expr(DIRTY[table][c]).alias(f"c{i}") for i, c in enumerate(own)]
    return TextTable(df.select(F.col("o_orderkey").alias("row_no"), *cells), own)
