"""The operator queries that SQL can express, against it, on small tables with awkward rows."""

import random

import duckdb
import pytest

from hornlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(17)
    path = str(tmp_path_factory.mktemp("tables"))
    passage = [f"p{k}" for k in range(64)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "a\tb\nc d\x0be f")]
    for i in range(5, 60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 160))]
        if i % 4 == 0:
            words[len(words) // 2 : 0] = passage
        docs.append((i, " ".join(words)))
    docs += [(60 + k, docs[10][1]) for k in range(3)] + [(70 + k, docs[11][1] + f" tail{k}") for k in range(4)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    hosts = ["a.example.com", "b.example.net", "example.org", "c.test", "d.test", "e.test"]
    pages = [(0, None, None), (1, "nothing", "")]
    for i in range(2, 60):
        links = "".join(f"<a href='http{rng.choice(['', 's'])}://{rng.choice(hosts).upper()}/x'>" for _ in range(rng.randrange(4))) + '<img src="//f.test/i"><a href="/own">'
        pages.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(90)}?q#f", links))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, tables)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_rows_of_all(spark, tables):
    for name in ("op1_pii_sanitisation", "op2_fingerprints", "op5_token_counts", "op9_language_id"):
        assert QUERIES[name](spark, tables).count() == 67
