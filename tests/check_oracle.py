"""Run registered queries next to their SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from offermill.plans.views import BASE_TABLES  # noqa: E402
from offermill.session import local_session  # noqa: E402

KINDS = {
    "long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9) + 0.0
        return x

    return sorted((tuple(cell(x) for x in row) for row in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "CROSS JOIN in the plan"
    names = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*names).collect()])
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} {took:.1f}s"
    start = time.time()
    rel = con.sql(sql)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(rel.columns) != names:
        return f"COLUMNS {names} {sorted(rel.columns)}"
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    off = {n: (mine[n], kinds[n]) for n in names if KINDS.get(mine[n]) != kinds[n]}
    want = canonical(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    timing = f"{len(got)} rows {took:.1f}s / {time.time() - start:.1f}s"
    if got != want:
        bad = next((p for p in zip(got, want) if p[0] != p[1]), None)
        return f"DIFF {len(got)} {len(want)} {bad} {off}"
    return ("TYPES " + str(off) if off else "ok") + " " + timing


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a] or list(entry.queries())
    spark = local_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in wanted:
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        failed += not verdict.startswith(("ok", "rows"))
        print(f"{name}: {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
