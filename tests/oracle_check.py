"""Compare registered queries with their SQL: ``python tests/oracle_check.py SF_DIR [query ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides have the same columns and rows, else what differs."""
    from crosslume.plans.oracle import ORACLE
    from crosslume.plans.queries import QUERIES

    got = canonical(QUERIES[name](spark, sf_dir).toPandas())
    want = canonical(con.execute(ORACLE[name]).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} vs {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    types = [(c, str(a), str(b)) for c, a, b in zip(got, got.dtypes, want.dtypes) if a != b]
    # Text columns only differ in how pandas stores them.
    types = [t for t in types if not {t[1], t[2]} <= {"object", "str", "string"}]
    if types:
        return f"types {types}"
    bad = pd.Series(False, index=got.index)
    for c in got:
        bad |= ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
    if bad.any():
        return f"{bad.sum()} of {len(got)} rows, first:\n{got[bad].head(3)}\n{want[bad].head(3)}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from crosslume.plans.oracle import ORACLE

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names or list(ORACLE):
        start = time.time()
        problem = difference(spark, con, name, sf_dir)
        failed += problem is not None
        print(f"{name}: {problem or 'same'} ({time.time() - start:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
