"""Compare a registered query with its SQL on one folder of tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def _key(x):
    return str(x) if not isinstance(x, float) else ("nan" if math.isnan(x) else repr(x))


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(_key(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(_key(dict(zip(names, r))[c]) for c in order) for r in want)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
