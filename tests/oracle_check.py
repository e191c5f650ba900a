"""Run registered queries in Spark and their SQL in DuckDB and compare."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, q):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - t0
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if q.sql is None:
        return {"name": q.name, "rows": len(got), "spark_s": spark_s, "ok": None, "why": "rows only"}
    t0 = time.time()
    rel = con.execute(q.sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = rows_of(cols, rel.fetchall())
    duck_s = time.time() - t0
    why = ""
    if got_cols != want_cols:
        why = f"columns {got_cols} vs {want_cols}"
    elif len(got) != len(want):
        why = f"rows {len(got)} vs {len(want)}"
    elif got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        why = f"{len(bad)} rows differ, first {str(bad[0][0])[:600]} vs {str(bad[0][1])[:600]}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    alias = {"NUMBER": "?", "STRING": "VARCHAR"}
    wrong = [f"{c}: {k} vs {types[c]}" for c, k in kinds.items() if c in types and names.get(k, k) != alias.get(types[c], types[c])]
    if wrong and not why:
        why = "types " + "; ".join(wrong)
    if not got and not why:
        why = "EMPTY"
    return {"name": q.name, "rows": len(got), "spark_s": spark_s, "duck_s": duck_s, "ok": not why, "why": why}


def main():
    import traceback

    from weftline.registry import all_queries
    from weftline.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = local_session()
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    bad = 0
    for q in all_queries().values():
        if names and not any(q.name.startswith(n) or q.run.__module__.endswith(n) for n in names):
            continue
        try:
            r = compare(spark, con, sf_dir, q)
        except Exception as e:  # report and go on
            r = {"name": q.name, "rows": -1, "spark_s": 0, "ok": False, "why": f"{type(e).__name__} {str(e)[:900]}"}
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += r["ok"] is False
        print(f"{'ok ' if r['ok'] else 'ROW' if r['ok'] is None else 'BAD'} {r['name']:28s} {r['rows']:7d} {r['spark_s']:6.2f}s {r.get('duck_s', 0):6.2f}s {r['why']}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
