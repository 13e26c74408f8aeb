"""Compare registered queries with their reference SQL, the way a reviewer would:
same columns, same rows, whatever the order."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, int):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, query, sql, sf):
    """(matches, spark rows, reference rows, first differences)"""
    df = query(spark, sf)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, len(left), len(right), [sorted(df.columns), sorted(names)]
    extra = [x for x in left if x not in set(right)][:3]
    missing = [x for x in right if x not in set(left)][:3]
    return left == right, len(left), len(right), [extra, missing]
