"""The corpus pipeline against a plain recomputation of each stage on that stage's own input, and the llm queries' SQL."""

import os
import re
from collections import Counter, defaultdict

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    from tessel.llm import mixing, quality_crf

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, before, docs))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
    (_, raw, good), (_, _, once), (_, _, single), (_, _, mix), (_, _, packed) = seen
    model = quality_crf.trained(raw, spark.read.parquet(f"{DATA}/labels.parquet"))
    accepted = {r["doc_id"] for r in quality_crf.scored(raw, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    owners = defaultdict(list)
    for r in good.collect():
        owners[r["text"]].append(r["doc_id"])
    assert {r["doc_id"]: r["text"] for r in once.collect()} == {max(v): t for t, v in owners.items()}
    from test_dedup import brute

    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert {r["doc_id"] for r in single.collect()} == {c for _, n, c in brute(rows) if n} | {d for d, n, _ in brute(rows) if not n}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(r["doc_id"] for r in mix.collect()) == {k: v for k, v in copies.items() if v}
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in mix.collect())
    assert packed.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").collect()[0][0] <= 2048


def _odd_documents(spark, path):
    """Nulls in every column, repeated ids, empty and very long texts, copies and clashing names."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = {r["doc_id"]: r["text"] for r in docs.where("length(text) between 400 and 900").orderBy("doc_id").limit(6).collect()}
    a, b, c, d, *_ = base.values()
    rows = [(None, a, None, None, None), (None, b, "en", "s", 1), (5, b, "en", "s", 1), (7, c, "en", None, 1), (7, b, None, "s", 1), (7, d, "en", "t", 1), (8, "", "en", "s", 0), (9, None, None, None, None), (9, " \n ", "en", "s", 3), (10, c + " " + " ".join([d] * 200), "en", "s", 1), (7, c, "en", None, 1)]
    odd = spark.createDataFrame([(*r, 1, "p", i) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, position string, piece bigint")
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (7, 1, 0), (8, 0, 0), (9, 0, 0), (10, 1, 0), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as P

    from tessel.llm import mixing

    docs = _odd_documents(spark, tmp_path)
    columns, outs = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        # The classifier may reject what it likes of so few labels; the other stages start from all rows.
        source = spark.read.parquet(f"{tmp_path}/documents.parquet") if i < 2 else spark.read.parquet(f"{tmp_path}/{i - 1}")
        stage(spark, source, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        outs.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or outs[-1].columns == columns
    _, once, single, mix, packed = outs
    texts = [r["text"] or "" for r in docs.collect()]
    assert sorted(r["text"] for r in once.collect()) == sorted(set(texts))
    from test_dedup import components_of, sets

    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert single.count() == sum(len(m) if not sets(rows[m[0]][1]) else 1 for m in components_of(rows))
    assert len({r["text"] for r in single.collect()}) == single.count()
    copies = sum(r["copies"] for r in mixing.mix(single).collect())
    assert mix.count() == copies == packed.where("piece = 0").count()


def test_order_and_passes_reach_the_sequences(spark, tmp_path):
    """Places in the packed output are those of the training order, and no sequence holds two passes of a document."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").dropDuplicates(["text"])
    P.mix_sources(spark, docs, DATA).write.parquet(str(tmp_path / "mix"))
    mix = spark.read.parquet(str(tmp_path / "mix"))
    order = [r["doc_id"] for r in mix.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    packed = P.pack_sequences(spark, mix, DATA).collect()
    assert [r["doc_id"] for r in sorted(packed, key=lambda r: r["position"]) if r["piece"] == 0] == order
    assert len(set(order)) < len(order)  # some documents have several passes
    held = Counter((r["sequence_id"], r["doc_id"], r["piece"]) for r in packed)
    assert max(held.values()) == 1


def test_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_and_registration(spark):
    import __spark_entry__ as e

    queries = e.queries()
    assert "pipeline" in queries and "pipeline" not in e.oracle_sql()
    assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))
    assert queries["pipeline"](spark, DATA).count() > 0


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessel.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
        want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)
        assert got == want, name


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "tessel")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name
