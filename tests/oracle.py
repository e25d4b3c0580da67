"""Holds a Spark result against the SQL twin's on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        return names, found.fetchall()


def _key(row):
    return tuple(("~" if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)) for v in row)


def compare(df, sql, sf):
    names, rows = rows_of_sql(sql, sf)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(_key([r[names.index(n)] for n in order]) for r in rows)
    got = sorted(_key([r[n] for n in order]) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (len(bad), bad[:3])
