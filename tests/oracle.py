"""Compares a Spark frame with the rows DuckDB gives for its twin."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if value != value else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "").removesuffix("T00:00:00")
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canonical(r[i]) for i in order) for r in records)


def compare(df, sql: str, sf: str = SF) -> None:
    result = connection(sf).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, result.fetchall())
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
