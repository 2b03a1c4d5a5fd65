"""Every core query against its SQL on the smallest tables."""

import pytest

from attestry.plans import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_query_equals_sql(spark, sf, same, name):
    same(Q.QUERIES[name](spark, sf), Q.ORACLES[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_template_scores_of_all_orders(spark, sf):
    with_customer = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct()
    got = Q.q_template_scores(spark, sf).select("doc_id").distinct()
    assert got.count() == with_customer.count() > with_customer.filter("o_custkey % 3 = 0").count()


def test_known_duplicates_of_any_document(spark, tmp_path):
    rows = [(5, "a"), (150, "b"), (160, "b"), (170, "a"), (180, None), (190, None), (200, "b"), (210, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in Q.q_known_duplicates(spark, str(tmp_path)).collect()) == [160, 170, 200]


def test_document_kinds_reads_past_a_million_lines(spark, tmp_path):
    rows = [(1, "\n" * 1_000_000 + "x" * 40), (2, "\n" * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, Q.q_document_kinds(spark, str(tmp_path)).select("doc_id", "kind").collect())) == [("1", "hybrid"), ("2", "scanned")]


def test_name_similarity_compares_different_names_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q.fuzzy, "KEYS", 3)  # so that copies fill more than one array
    names = ["hot bolt", "hot bolt", "old bolt", "", "", None, None, "hot bölt", "hot bolt\n"]
    rows = [(k, names[k * 7 % 9] if k % 3 else "hot bolt", ("LARGE", "SMALL", None)[k % 7 % 3], k % 2 if k % 11 else None) for k in range(60)]
    rows += [(7, "hot bolt", "LARGE", 1), (7, "old bolt", "LARGE", 1), (None, "old bolt", "LARGE", 1)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    pairs = Q.q_name_similarity(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(keys_b") < plan.index("levenshtein")  # names are compared before their copies are expanded
    a, b = (part.selectExpr(f"p_partkey as {s}", f"p_name as n{s}", "p_type", "p_size") for s in "ab")
    want = a.join(b, ["p_type", "p_size"]).filter("a < b").select("a", "b", Q.F.round(Q.fuzzy.similarity(Q.F.col("na"), Q.F.col("nb")), 6).alias("sim"))
    assert want.count() > 200
    assert pairs.exceptAll(want).count() == want.exceptAll(pairs).count() == 0
