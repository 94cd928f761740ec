"""Runs named queries and their SQL side by side."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return ("n", round(v, 6))
    if hasattr(v, "is_integer") or isinstance(v, int) or type(v).__name__ == "Decimal":
        return ("n", round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty text when both sides agree."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if sql is None:
        return "" if sum(ours.values()) else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    if ours == theirs:
        return ""
    a, b = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return f"rows {sum(ours.values())} against {sum(theirs.values())}; only ours {a}; only SQL {b}; columns {cols}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import session

    spark = session()
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    wanted = sys.argv[2:]
    con, bad, total = duck(sf_dir), [], 0
    for name, query in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        total += 1
        start = time.time()
        try:
            said = compare(spark, con, sf_dir, name, query, oracle_sql().get(name))
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok ' if not said else 'BAD'} {name} {time.time() - start:.1f}s {said[:1200]}", flush=True)
        if said:
            bad.append(name)
    print(f"{total - len(bad)} of {total} agree; bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
