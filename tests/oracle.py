"""Runs registered queries and their DuckDB SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def rows(frame) -> list[tuple]:
    """Rows in an order that small differences of floats don't change; dates as text, NaN as null."""
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)[:10] if hasattr(x, "year") else x
    rough = lambda x: f"{x:.3e}" if isinstance(x, float) else repr(x)
    return sorted((tuple(clean(x) for x in r) for r in frame), key=lambda r: ([repr(x) for x in r if not isinstance(x, float)], [rough(x) for x in r]))


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same rows: doubles to a relative 1e-9 or an absolute 1e-12, or to one in the last of 6 digits where
    both are rounded to them; all else exactly, bool and int told apart."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    df = query(spark, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {df.columns} and {names}"
    a, b = rows([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]), rows(out.fetchall())
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"

    def same(p, q) -> bool:
        if isinstance(p, float) and isinstance(q, float):
            return math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-12) or (p == round(p, 6) and q == round(q, 6) and abs(p - q) < 1.5e-6 and tied.append(1) is None)
        return p == q and isinstance(p, bool) == isinstance(q, bool)

    tied = []
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    if len(tied) > max(2, len(a) // 1000):
        return f"{name}: {len(tied)} values of {len(a)} rows differ in the last digit"
    return f"{name}: {len(bad)} rows differ, as {bad[0]}" if bad else ""
