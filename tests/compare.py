"""Run registered queries next to their SQL counterparts and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        differs = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if differs.any():
            i = differs.idxmax()
            return (f"column {c}: {int(differs.sum())} rows differ, first "
                    f"{a.loc[i].to_dict()} != {b.loc[i].to_dict()}")
    return None


def check(spark, con, folder: str, name: str, queries: dict, oracle: dict) -> str | None:
    got = queries[name](spark, folder).toPandas()
    if name not in oracle:
        return None if len(got) else "no rows"
    return difference(got, con.execute(oracle[name]).df())


def main() -> None:
    import __spark_entry__ as entry
    from lehrplan.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, folder, name, entry.queries(), entry.oracle_sql())
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
