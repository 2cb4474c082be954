"""Run registered queries on both engines and compare the tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value.item() if hasattr(value, "item") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(cell(row[i]) for i in order) for row in rows), key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    )


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs; empty if the tables are the same."""
    answer = con.execute(sql)
    expected_columns = [c[0] for c in answer.description]
    expected_types = {c[0]: str(c[1]) for c in answer.description}
    expected = rows_of(expected_columns, answer.fetchall())
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    notes = []
    if sorted(expected_columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind) != expected_types[name]:
            notes.append(f"type of {name}: {kind} != {expected_types[name]}")
    if len(expected) != len(found):
        notes.append(f"{len(found)} rows, expected {len(expected)}")
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        notes.append(f"{len(wrong)} rows differ, first {sorted(spark_df.columns)}: {wrong[0][0]} expected {wrong[0][1]}")
    return notes
