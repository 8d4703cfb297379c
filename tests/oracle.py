"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in data), key=repr)


def differences(df, con, sql):
    """What differs, None if nothing."""
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want_names, want = rows(names, out.fetchall())
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names}, not {want_names}"
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(close, g, w))]
    return f"{len(wrong)} of {len(want)} rows differ: {wrong[0]}" if wrong else None
