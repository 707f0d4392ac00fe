"""The operators' queries that SQL can express, against DuckDB on the smallest tables and on odd rows."""

import duckdb
import pytest

from chronolith.llm import queries
from tests.test_oracles import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def compared(spark, folder, name):
    found = queries.queries()[name](spark, str(folder))
    columns = sorted(found.columns)
    got = sorted(str([r[c] for c in columns]) for r in found.collect())
    with duckdb.connect() as connection:
        for path in folder.glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else path
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
        made = connection.execute(queries.oracle_sql()[name])
        names = [d[0] for d in made.description]
        want = sorted(str([r[names.index(c)] for c in columns]) for r in made.fetchall())
    assert sorted(names) == columns and got == want and got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    compared(spark, DATA, name)


def test_odd_conversations_and_pages(spark, tmp_path):
    text = ["ok", "", None, "<|end|> [x] & é 😀", "word " * 900, "long\tturn\n" * 400, "a1b22c333 " * 60]
    turns = [(c, t if t % 11 else None, ("system", "user", "assistant", None)[0 if t == 0 and c % 2 else 1 + (t * 7 + c) % 3], text[(t * 5 + c) % 7]) for c in range(12) for t in range(14)]
    turns += [(40, 4095 + n, "user", "w " * 700) for n in range(5)] + [(None, 3, "assistant", "x"), (None, 2, "user", "y"), (41, 0, "system", "s " * 600), (41, 1, "user", "u")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    urls = [None, "", "plain", "HTTP://A.Example.ORG/es/1?q", "http://freebets.com/fr/x", "http://x.net/Click_Bait/", "http://org/", "://h", "http://a.net/get-richquick", "http://u@com:1/de/"]
    spark.createDataFrame([(n, u) for n, u in enumerate(urls * 2)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op7_url_filter", "op10_chat"):
        compared(spark, tmp_path, name)
