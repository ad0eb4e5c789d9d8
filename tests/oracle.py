"""Comparison of a query with its SQL, the way the driver does it: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def same(frame, db, sql):
    names = sorted(frame.columns)
    got = [tuple(plain(r[n]) for n in names) for r in (x.asDict(True) for x in frame.collect())]
    rel = db.sql(sql)
    at = [rel.columns.index(n) for n in names]
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    wanted = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    got, wanted = sorted(got, key=repr), sorted(wanted, key=repr)
    assert len(got) == len(wanted), (len(got), len(wanted))
    for g, w in zip(got, wanted, strict=True):
        assert g == w, (names, g, w)
    return len(got)
