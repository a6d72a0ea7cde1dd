"""Compare registered queries with their SQL twins on a data folder.

    python tests/compare.py FOLDER [QUERY ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tributary.plans.queries import ORACLES, QUERIES, TABLES  # noqa: E402


def _cell(value) -> str:
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> dict:
    started = time.time()
    df = QUERIES[name](spark, folder)
    columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    out = {"query": name, "rows": len(got), "sec": round(took, 2), "ok": None, "detail": ""}
    if name in ORACLES:
        started = time.time()
        cur = con.execute(ORACLES[name])
        wanted_columns, wanted = _rows([d[0] for d in cur.description], cur.fetchall())
        out["sql_sec"] = round(time.time() - started, 2)
        if columns != wanted_columns:
            out.update(ok=False, detail=f"columns {columns} <> {wanted_columns}")
        elif got != wanted:
            extra = [r for r in got if r not in set(wanted)][:3]
            lost = [r for r in wanted if r not in set(got)][:3]
            out.update(ok=False, detail=f"rows {len(got)} <> {len(wanted)}; only here {extra}; only there {lost}")
        else:
            out["ok"] = True
        out["hash"] = hashlib.md5(repr(got).encode()).hexdigest()[:8]
    return out


def main() -> int:
    from tributary.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("compare")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            r = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the others
            r = {"query": name, "ok": False, "rows": -1, "sec": 0, "detail": f"{type(e).__name__}: {str(e)[:700]}"}
        bad += r["ok"] is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]], name, r["rows"], r["sec"], r.get("sql_sec", ""), r["detail"][:1500], flush=True)
    print("failed", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(main())
