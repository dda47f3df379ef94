"""The DuckDB statements reach the end of deep paths."""

import duckdb

from tonegrid.plans.queries import ORACLES as CORE


def answer(sql, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(sql)
    return [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]


def test_depth_of_deep_paths():
    deep = "/".join(f"d{i}" for i in range(40))
    rows = answer(CORE["resolve_files"], pages=("page_id BIGINT, url VARCHAR", [(1, f"x/{deep}"), (2, f"y/{deep}")]))
    assert [(r["pid"], r["bucket"], r["file_id"], r["depth"]) for r in sorted(rows, key=lambda r: r["pid"])] == [(1, "matched", 1, 41), (2, "matched", 2, 41)]
