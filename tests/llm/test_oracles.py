"""The operators that SQL can express against DuckDB, on the given tables and on odd ones."""

import os
from collections import Counter

import duckdb
import pytest

from linkspan.llm import quality, queries, warc
from linkspan.llm.oracles import ORACLES


def same(found, relation):
    names = sorted(relation.columns)
    assert sorted(found.columns) == names
    got = Counter(map(tuple, found.select(*names).collect()))
    want = Counter(relation.select(*names).fetchall())
    assert got == want, list((got - want).items())[:2] + list((want - got).items())[:2]
    return sum(got.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    assert same(queries.queries()[name](spark, sf_dir), con.sql(ORACLES[name])) > 0


def test_odd_documents(docs, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    lines = ["A | B | C", "WE SHOUT! AT! YOU!", "see » this › page", "## $$ %% x", "Click Here To win", "a long line of plain prose that names our privacy policy once and then goes on for many more words about the sea and the old town by the river, so that the phrase is a small part of it " * 2, "यह एक सादा हिन्दी वाक्य है जिसमें बहुत मात्राएँ हैं।", "plain words in a line of prose", "plain words in a line of prose"]
    more = [(9000 + n, "\n".join(lines[n:] + lines[:n][: n // 2]), *rows[0][2:]) for n in range(len(lines))]
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in [*rows, *more]])
    table = docs.union(docs.sparkSession.createDataFrame(more, docs.schema))
    assert same(quality.rules(table), con.sql(ORACLES["op6_quality"])) == len(rows) + len(more)


def test_odd_pages(spark):
    con = duckdb.connect()
    pages = [(1, None), (2, ""), (None, ""), (5, "<p>é</p>"), (4, "<p>é</p>"), (4, "<p>é</p>"), (None, "<b>"), (None, "<b>"), (7, "x" * 100_000)]
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    table = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    assert same(warc.archive(table), con.sql(ORACLES["op10_warc"])) == len(pages)
