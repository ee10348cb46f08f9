"""Compare a query with its SQL as multisets of rows."""

import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def check(spark, duck, data, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
