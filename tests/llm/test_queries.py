import glob
import os
import zlib

import duckdb
import pytest

from weftline.llm.queries import ORACLES, QUERIES


def rows_of(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    told = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert told(r.asDict() for r in QUERIES[name](spark, sf).collect()) == told(rows_of(con, ORACLES[name]))


def test_checksums_of_odd_texts_in_sql():
    texts = ["", None, "a", "é漢\U0001f600", "x y\n" * 50]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert {r["doc_id"]: r["text_crc32"] for r in rows_of(con, ORACLES["op3_sharding"])} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
