"""A query's rows beside those of its SQL, as sorted lists of plain values."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(df, sql, folder):
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    answer = connect(folder).sql(sql)
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in answer.fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not different, different[:3]
