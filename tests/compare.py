"""Rows of a Spark and a DuckDB result in a common form."""

import math


def said(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def same(df, con, sql: str) -> None:
    got = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(said(r[c]) for c in order) for r in got)
    theirs = sorted(tuple(said(dict(zip(names, r))[c]) for c in order) for r in cursor.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
