"""Runs queries and their SQL on the smallest tables and compares rows, whatever their order."""

import math
from pathlib import Path


def _text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_text, value)) + "]"
    return str(value)


def differences(spark, folder, query, sql):
    import duckdb

    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted("|".join(_text(r[c]) for c in columns) for r in df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted("|".join(_text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    return set(ours) ^ set(theirs) or (len(ours) != len(theirs))
