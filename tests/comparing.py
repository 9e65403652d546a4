"""Compares a Spark result with DuckDB's, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np


def plain(x):
    if x is None or x is np.ma.masked:
        return None
    if isinstance(x, np.ndarray | list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, float | np.floating):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int | np.integer):
        return int(x)
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    return x


def ordered(rows):
    return sorted(rows, key=repr)


def oracle(sf_dir: str, sql: str):
    base = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        base.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    found = base.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], ordered(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered(tuple(plain(r[n]) for n in names) for r in (x.asDict(recursive=True) for x in df.collect()))


def close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and not isinstance(a, str) and not isinstance(b, str) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) or a == b
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b, strict=True))
    return a == b


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, want = oracle(sf_dir, sql)
    own, got = spark_rows(df)
    assert own == names
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert close(g, w), (g, w)
