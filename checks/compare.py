"""Run queries against their DuckDB twins: ``python -m checks.compare [sf_dir] [name...]``."""

import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from pagemill.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def differences(spark, con, sf_dir: str, name: str) -> tuple[int, list[str]]:
    """Row count, and the first rows that are on one side only."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return len(ours), [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    if ours == theirs:
        return len(ours), []
    only = [f"spark {r}" for r in sorted(set(ours) - set(theirs))[:3]]
    only += [f"duckdb {r}" for r in sorted(set(theirs) - set(ours))[:3]]
    return len(ours), [f"{len(ours)} and {len(theirs)} rows", *only]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            count, wrong = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            count, wrong = 0, [str(error)[:1500]]
        print(f"{'ok  ' if not wrong else 'FAIL'} {name} {count} rows {time.time() - start:.2f}s", flush=True)
        for line in wrong:
            print("    ", line)


if __name__ == "__main__":
    main()
