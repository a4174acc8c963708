"""Run a registered query and its SQL on the same tables and compare all rows."""

import math
from pathlib import Path

import duckdb
import pyarrow as pa


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = [tuple(_normal(r[n]) for n in names) for r in table.select(names).to_pylist()]
    return sorted(rows, key=repr)


def _types(table: pa.Table) -> dict[str, str]:
    plain = {"large_string": "string", "null": "string"}
    return {f.name: plain.get(str(f.type), str(f.type)) for f in table.schema}


def compare(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    problems = []
    if _types(spark_table) != _types(duck_table):
        a, b = _types(spark_table), _types(duck_table)
        diff = {k: (a.get(k), b.get(k)) for k in {*a, *b} if a.get(k) != b.get(k)}
        problems.append(f"types (spark, sql): {diff}")
        if set(a) != set(b):
            return problems
    left, right = _rows(spark_table), _rows(duck_table)
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)}, sql {len(right)}")
    if left != right:
        ls, rs = set(left), set(right)
        problems.append(
            f"columns {sorted(spark_table.column_names)}; only spark {list(ls - rs)[:3]}; only sql {list(rs - ls)[:3]}"
        )
    return problems
