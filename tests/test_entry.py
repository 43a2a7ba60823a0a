import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessel.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")

    def shown(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    wrong = []
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted(tuple(shown(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        cursor = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})")
        if got != sorted(tuple(shown(v) for v in r) for r in cursor.fetchall()):
            wrong.append(name)
    assert not wrong


def test_whole_values_against_python(spark):
    from tessel.queries import QUERIES

    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    joined = {r["i"]: r["s"] for r in QUERIES["str_split_join_whole"](spark, DATA).collect()}
    assert joined == {r["doc_id"]: r["text"].replace(" ", "-") for r in read("documents")}
    entries = sorted((r["i"], r["k"], r["v"]) for r in QUERIES["vec_entries_whole"](spark, DATA).collect())
    assert entries == sorted((r["vec_id"], k, v) for r in read("embeddings") for k, v in enumerate(r["embedding"]))

    def steps(x):
        n = 0
        while x != 1:
            x, n = (x // 2 if x % 2 == 0 else 3 * x + 1), n + 1
        return n

    found = {r["o_orderkey"]: r["steps"] for r in QUERIES["collatz_keys"](spark, DATA).collect()}
    assert found == {r["o_orderkey"]: steps(r["o_orderkey"] + 1) for r in read("orders")}
