"""Row-exact comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from decimal import Decimal


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "asDict"):
        return repr(sorted(v.asDict().items()))
    if isinstance(v, (list, dict)):
        return repr(v)
    return v


def _kind(rows, i):
    kinds = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return "/".join(sorted(kinds)) or "null"


def table(columns, rows):
    """Columns in name order, rows sorted, values plain."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    kinds = [_kind(out, i) for i in range(len(order))]
    plain = [tuple(_plain(v) for v in r) for r in out]
    return [columns[i] for i in order], kinds, sorted(plain, key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def difference(spark_df, cursor) -> str | None:
    """None when both hold the same rows, else what differs first."""
    a_names, a_kinds, a = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    b_names, b_kinds, b = table([c[0] for c in cursor.description], cursor.fetchall())
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}\n  spark {a[:3]}\n  duck  {b[:3]}"
    kinds = [(n, x, y) for n, x, y in zip(a_names, a_kinds, b_kinds) if x != y and "null" not in (x, y)]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        where = [n for i, n in enumerate(a_names) if any(x[i] != y[i] for x, y in bad)]
        return f"{len(bad)}/{len(a)} rows differ in {where}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    return f"types {kinds}" if kinds else None
