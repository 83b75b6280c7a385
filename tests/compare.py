"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in df[names].itertuples(index=False, name=None)), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark_df, con, sql):
    """None, or what differs."""
    got, want = rows_of(spark_df.toPandas()), rows_of(con.execute(sql).df())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1]):
        if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.01e-6)) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return None
