"""Compare every registered query with its SQL on one scale folder.

    python tools/check_sql.py [folder] [query …]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from fathomix.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def differences(spark, con, folder: str, name: str) -> str | None:
    """None where both engines agree on columns and on the multiset of rows."""
    ours = QUERIES[name](spark, folder)
    columns = sorted(ours.columns)
    mine = Counter(tuple(_plain(r[c]) for c in columns) for r in ours.collect())
    cursor = con.execute(ORACLE[name])
    theirs_columns = [c[0] for c in cursor.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} and {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    if mine == theirs:
        return None if mine else "both are empty"
    left, right = mine - theirs, theirs - mine
    shown = [str(next(iter(side), None))[:600] for side in (left, right)]
    return (
        f"{mine.total()} rows and {theirs.total()}; {left.total()} only here, {right.total()} only in SQL"
        f"\n    here {columns}\n    here {shown[0]}\n    SQL  {shown[1]}"
    )


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    shared = tempfile.mkdtemp(prefix="fathomix-check-")
    spark = build_session("local[8]", 8, **{"spark.checkpoint.dir": shared, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        if name not in ORACLE:
            print(f"no SQL {name}", flush=True)
            continue
        try:
            found = differences(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
