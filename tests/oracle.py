"""Queries against their SQL: python tests/oracle.py SF_DIR [NAME...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order)) for v in values)


def differences(spark, sf_dir: str, names=()):
    """name and what differs, for each query with SQL."""
    import __spark_entry__ as entry

    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or sql:
        got = queries[name](spark, sf_dir)
        told = con.execute(sql[name])
        want_columns = [c[0] for c in told.description]
        if sorted(got.columns) != sorted(want_columns):
            yield name, f"columns {got.columns} and {want_columns}"
            continue
        a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want_columns, told.fetchall())
        if a != b:
            only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
            yield name, f"{len(a)} and {len(b)} rows; {str(only)[:700]}"
        else:
            yield name, ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for name, what in differences(session, sys.argv[1], sys.argv[2:]):
        print("ok  " if not what else "BAD ", name, what, flush=True)
