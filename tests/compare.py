"""Compare a query with its SQL oracle: same columns, types, rows and values."""

from __future__ import annotations

import os
from collections.abc import Iterable

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def _kind(dtype: str) -> str:
    dtype = dtype.lower()
    for names, kind in (
        (("timestamp",), "timestamp"), (("date",), "date"), (("varchar", "string"), "string"),
        (("double",), "double"), (("float", "real"), "float"), (("boolean",), "bool"),
        (("hugeint", "decimal"), "wide"), (("bigint", "long"), "long"), (("int",), "int"),
    ):
        if dtype.startswith(names):
            return kind
    return dtype


def _rows(rows: Iterable[tuple]) -> list[tuple]:
    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "<null>"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    rel = con.sql(sql)
    want_types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    out = []
    if sorted(want_types) != sorted(got_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    out += [f"type of {c}: {got_types[c]} != {want_types[c]}" for c in sorted(want_types) if want_types[c] != got_types[c]]
    cols = sorted(want_types)
    want = _rows(rel.df()[cols].astype(object).itertuples(index=False, name=None))
    got = _rows(df.select(*cols).collect())  # not by pandas, which turns longs beside nulls into floats
    if len(want) != len(got):
        out.append(f"rows {len(got)} != {len(want)}")
    ws, gs = set(want), set(got)
    if want != got:
        out.append(f"only spark: {sorted(gs - ws)[:3]}; only oracle: {sorted(ws - gs)[:3]} of {cols}")
    return out
