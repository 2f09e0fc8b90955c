"""Result of a query against the result of its SQL, independent of row and column order."""

import datetime
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v) if isinstance(v, float) else str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(row[k]) for k in order) for row in rows)


def spark_result(df):
    return canonical(df.columns, df.collect())


def duck_result(connection, sql):
    cursor = connection.execute(sql)
    return canonical([c[0] for c in cursor.description], cursor.fetchall())
