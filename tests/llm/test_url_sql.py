"""The url filter's SQL against its query on pages with links in every attribute order."""

import duckdb
from pyspark.sql import functions as F

from hexgiving.llm import oracle, queries
from hexgiving.session import shared_dir

TARGET = "http://a.example.org/es/blocked"
LINKS = [f'<meta http-equiv="refresh" content="0; url={TARGET}">', f'<meta content="0; url={TARGET}" http-equiv="refresh">',
         f"<meta content='0;URL={TARGET}' http-equiv=refresh>", f'<link rel="canonical" href="{TARGET}">',
         f'<link href="{TARGET}" rel="canonical">', f'<link rel="alternate canonical" href={TARGET}>', f"<link rel='canonical x' href='{TARGET}'>",
         f'<link rel="noncanonical" href="{TARGET}">', f'<meta content="0; url={TARGET}" http-equiv="x-refresh">', "<p>none</p>",
         '<link rel="canonical" href="/2">', '<meta http-equiv=refresh content="0; url=//h3.test/p3">']


def test_sql_follows_links_in_every_attribute_order(spark):
    rows = [(i, f"http://h{i}.test/p{i}?q", f"<html>{html}</html>") for i, html in enumerate(LINKS)]
    rows += [(100, TARGET, None), (101, None, LINKS[0]), (102, "no scheme", LINKS[3]), (103, "http://WWW.x.com/fr/1", ""), (104, "http://h3.test/p3", "")]
    path = shared_dir(spark, "url-pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    got = queries.op2_url_filter(spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path.removeprefix('file:')}/pages.parquet/*.parquet'")
    want = con.sql(oracle.ORACLE["op2_url_filter"])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall(), key=str)
    blocked = {r["page_id"] for r in got.where(F.col("verdict") == "block").collect()}
    assert set(range(7)) <= blocked and not blocked & {7, 8, 9}
