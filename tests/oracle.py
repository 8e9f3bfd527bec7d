"""Runs registered queries next to their SQL twins and compares the rows."""

import math
import sys
import time

import duckdb

from shelfline.bindings import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return str([_cell(x) for x in value])
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        return _cell(value.tolist())
    if hasattr(value, "isoformat"):
        return str(value).split("+")[0]
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_cell(row[i]) for i in order]) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty list if both sides agree, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return [f"{name}: columns {sorted(df.columns)} != {sorted(columns)}"]
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return [f"{name}: rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"]


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from shelfline.session import build_session

    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, name, fn, oracles[name], sf_dir)
                state = "ok" if not problems else "DIFF " + problems[0][:1500]
            else:
                state = f"rows {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            state = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(*sys.argv[1:])
