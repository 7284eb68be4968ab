"""Run registered queries next to their SQL on DuckDB and compare the values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(pdf, columns):
    return sorted(tuple(canonical(v) for v in row) for row in pdf[columns].astype(object).itertuples(index=False, name=None))


def plain(pdf):
    """Columns of nullable integers as pandas has them elsewhere: doubles if there is a null, else integers."""
    for c in pdf.columns:
        if str(pdf[c].dtype) in ("Int64", "Int32"):
            pdf[c] = pdf[c].astype("float64" if pdf[c].isna().any() else pdf[c].dtype.numpy_dtype)
    return pdf


def differences(spark_pdf, duck_pdf) -> str | None:
    spark_pdf, duck_pdf = plain(spark_pdf), plain(duck_pdf)
    a, b = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if a != b:
        return f"columns differ: only spark {sorted(set(a) - set(b))}, only sql {sorted(set(b) - set(a))}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    kinds = [(c, spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind) for c in a]
    odd = [k for k in kinds if k[1] != k[2] and not {k[1], k[2]} <= {"O"}]
    left, right = rows_of(spark_pdf, a), rows_of(duck_pdf, a)
    if left == right:
        return f"types differ: {odd}" if odd else None
    wrong = [(x, y) for x, y in zip(left, right) if x != y]
    x, y = wrong[0]
    return f"{len(wrong)} rows differ, first: " + str([(c, p, q) for c, p, q in zip(a, x, y) if p != q])


def main(argv):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    from tidewatch.session import local_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                want = con.execute(oracles[name]).fetchdf()
                problem = differences(got, want)
                note = f"duckdb {time.time() - start:.2f}s"
            else:
                problem, note = None, "rows only"
        except Exception as e:  # show and go on with the next query
            problem, took, note = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - start, ""
            got = ()
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:34s} rows={len(got):7d} spark {took:.2f}s {note} {problem or ''}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
