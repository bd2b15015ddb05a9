"""Run named queries next to their SQL: python tests/check_sql.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from spanseek.catalogue import all_queries  # noqa: E402
from spanseek.session import local_session  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(frame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
        return v
    names = sorted(frame.schema.names)
    columns = [frame[n].to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in row) for row in zip(*columns)), key=repr)


def compare(spark, folder: str, name: str) -> str:
    queries, sql = all_queries()
    t = time.time()
    mine = queries[name](spark, folder).toArrow()
    took = time.time() - t
    if name not in sql:
        return f"rows  {name}: {mine.num_rows} rows {took:.1f}s"
    con = duckdb.connect()
    for n in NAMES.split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    t = time.time()
    theirs = con.sql(sql[name]).to_arrow_table()
    sql_took = time.time() - t
    if sorted(mine.schema.names) != sorted(theirs.schema.names):
        return f"FAIL  {name}: columns {mine.schema.names} / {theirs.schema.names}"
    a, b = rows_of(mine), rows_of(theirs)
    types = [(n, str(mine.schema.field(n).type), str(theirs.schema.field(n).type)) for n in mine.schema.names
             if str(mine.schema.field(n).type) != str(theirs.schema.field(n).type)]
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
        counts, only_a, only_b = (len(only_a), len(only_b)), only_a[:3], only_b[:3]
        return f"FAIL  {name}: {len(a)} / {len(b)} rows, {counts} differ; {only_a} / {only_b} {types}"
    return f"ok    {name}: {len(a)} rows, spark {took:.1f}s sql {sql_took:.1f}s {types or ''}"


if __name__ == "__main__":
    session = local_session(cores="8")
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    for q in sys.argv[2:] or list(all_queries()[0]):
        try:
            print(compare(session, where, q), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {q}: {type(e).__name__} {str(e)[:1500]}", flush=True)
