"""Run registered queries on Spark and their SQL on DuckDB, and compare."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.10g}") + 0.0
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark_df, con, sql: str) -> str | None:
    """None when both agree in columns, types, row count and values."""
    started = time.time()
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    middle = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = rows(names, result.fetchall())
    print(f"     spark {middle - started:.1f}s sql {time.time() - middle:.1f}s", flush=True)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    for name, kind in spark_df.dtypes:
        if KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} vs {kinds[name]}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference\n   spark {a}\n   sql   {b}"
    return None


def main(folder: str, prefixes: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from citeloom.catalogue import ORACLES, QUERIES, load_all
    from citeloom.session import build_session

    load_all()
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    con, bad, started = connect(folder), 0, time.time()
    for name, run in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = run(spark, folder)
            if name in ORACLES:
                problem, count = difference(df, con, ORACLES[name]), ""
            else:
                problem, count = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {count} {problem or ''}", flush=True)
    print(f"{bad} failing, {time.time() - started:.0f}s")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
