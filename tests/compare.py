"""Run queries against their SQL twins in DuckDB: python tests/compare.py [sf_dir] [names..]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns), ignore_index=True)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    notes = []
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind or a[c].dtype.itemsize != b[c].dtype.itemsize:
            notes.append(f"{c}: dtype {a[c].dtype} vs {b[c].dtype}")
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int((~same).to_numpy().argmax())
            notes.append(f"{c}: {int((~same).sum())} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
    return "; ".join(notes) or None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[2:])]
    spark, con, bad = session(), connect(sf_dir), 0
    for name in names:
        try:
            start = time.time()
            mine = queries[name](spark, sf_dir).toPandas()
            mid = time.time()
            note = "rows only"
            if name in oracle:
                theirs = con.execute(oracle[name]).fetchdf()
                note = difference(mine, theirs)
                bad += note is not None
            print(f"{name}: {note or 'ok'} [{len(mine)} rows, {mid - start:.1f}s, sql {time.time() - mid:.1f}s]", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
