"""Rows of a Spark and a DuckDB result in one comparable form."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert ours == theirs
