"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import harness
import pytest

from entigraph import catalog_queries
from entigraph.llm.common import load
from entigraph.operators.search import nearest_vectors, nearest_vectors_lsh
from entigraph.plans import ir

SQL = catalog_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    assert harness.difference(catalog_queries.queries()[name](spark, small), small, SQL[name]) == ""


def test_without_sql(spark, small):
    rest = {n: f for n, f in catalog_queries.queries().items() if n not in SQL}
    assert set(rest) == {"vector_knn_lsh", "text_match_stemmed"}
    near = {r.vec_id for r in catalog_queries.queries()["vector_knn_euclidean"](spark, small).collect()}
    approximate = {r.vec_id for r in rest["vector_knn_lsh"](spark, small).collect()}
    assert len(approximate) == 10 and len(near & approximate) >= 5
    assert {"doc_id", "score"} == set(rest["text_match_stemmed"](spark, small).columns)


@pytest.mark.parametrize("name", ["text_phrase", "text_match"])
def test_text_search_with_many_matches(spark, small, name):
    """More than a thousand documents match: all come back, or the thousand best where the SQL says so."""
    large = small.replace("0.001", "0.1")
    found = catalog_queries.queries()[name](spark, large)
    assert harness.difference(found, large, SQL[name]) == ""
    assert found.count() > 1000 if name == "text_phrase" else found.count() == 1000


def test_recall_of_the_vector_index(spark, small):
    """All rows whose id is divisible by 100 as queries, against the exact search over all rows."""
    rows = load(spark, small.replace("0.001", "0.1"), "embeddings").cache()
    found = wanted = 0
    for r in rows.where("vec_id % 100 = 0").collect():
        what = ir.VectorNear("embedding", tuple(map(float, r.embedding)), 10, None, "euclidean")
        exact, near = ({n.vec_id for n in search(rows, what, ("vec_id",)).collect()} for search in (nearest_vectors, nearest_vectors_lsh))
        found, wanted = found + len(exact & near), wanted + len(exact)
    print(f"recall {found} of {wanted}")
    assert wanted >= 100 and found >= 0.9 * wanted
    rows.unpersist()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, small):
    plan = catalog_queries.queries()["filter_gt"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["text_boolean", "text_match"])
def test_equal_rounded_scores_at_the_limit(spark, tmp_path, name):
    """1300 matches whose scores differ only behind the fourth digit: the SQL takes the 1000 smallest ids of each rounded score."""
    rows = [(k, f"the and der {'word ' * (k * 7 % 13)}") for k in range(1300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.execute(catalog_queries.oracle_sql()[name]).fetchall()
    assert [tuple(r) for r in catalog_queries.queries()[name](spark, str(tmp_path)).collect()] == want


def test_equal_rounded_scores_above_a_least_score(spark, tmp_path):
    """Long texts of nearly one length: 40 of 100 match with scores that differ behind the fourth digit, and 20 are wanted."""
    rows = [(k, f"{'und der ' if k < 40 else ''}{'word ' * (9000 + k * 7 % 5)}") for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.execute(SQL["text_match_min_score"].replace("LIMIT 1000", "LIMIT 20")).fetchall()
    assert len(want) == 20 and len({score for _, score in want}) < 5 and want[0][1] >= 1
    found = catalog_queries._text(ir.TextMatch("text", "und der", 1.0, "precise"), 20)(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == want


@pytest.mark.parametrize("name", ["text_match_min_score", "text_phrase", "text_tokens", "text_postings"])
def test_missing_texts_and_letters_with_two_small_forms(spark, tmp_path, name):
    """Null texts count as documents but not in the mean length; a dotted I and a final sigma are one letter each."""
    rows = [(k, None if k % 3 == 0 else f"{'und der of the' if k % 5 == 1 else ''} DİL ΟΔΟΣ {'İki ' * (k % 7)}{'word ' * (k % 11)}") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = connection.execute(SQL[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = catalog_queries.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert len(want) > 10 and sorted(tuple(r) for r in got) == sorted(want)
