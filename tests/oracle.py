"""Compare a Spark result with DuckDB SQL on the same tables, as sorted rows."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = p if os.path.isfile(p) else p + "/*.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(str(float(r[k])) if isinstance(r[k], float) else str(r[k]) for k in order) for r in data))


def compare(df, con, sql):
    cur = con.execute(sql)
    want = rows([x[0] for x in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    diff = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not diff, diff[:3]
    return len(got[1])
