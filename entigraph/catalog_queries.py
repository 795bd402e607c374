"""The registered queries over the sample tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.functions import text
from entigraph.operators import constraints, graph, migration, search, security, store
from entigraph.plans import ir, language
from entigraph.plans.ir import Aggregate, AggregateQuery, And, In, Like, Null, Or, Order, contains, ends_with, eq, ge, gt, le, lt, ne, starts_with
from entigraph.plans.workspace import fresh_path
from entigraph.sources import sinks
from entigraph.sources.tables import SCHEMA, engine, load
from entigraph.streaming import changes

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _query(sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        _add(run.__name__, run, sql)
        return run

    return keep


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- scans, filters, pages ---------------------------------------------------


def _rows(entity: str, fields: str, where: ir.Filter | None = None, **more) -> Run:
    query = ir.GraphQuery(entity, tuple(fields.split()), where, **more)
    return lambda spark, d: engine(spark, d).execute(query).root


_LABELLED = "(SELECT doc_id, lang, n_chars, quality, toxic, CASE quality WHEN 1 THEN 'good_doc' WHEN 0 THEN 'bad%doc' END AS grade FROM documents LEFT JOIN labels USING (doc_id))"

_add("scan_all", _rows("Region", "r_regionkey r_name"), "SELECT r_regionkey, r_name FROM region")
_add("scan_project", _rows("Customer", "c_custkey c_name c_acctbal"), "SELECT c_custkey, c_name, c_acctbal FROM customer")
_add("scan_by_id", _rows("Order", "o_orderkey o_totalprice", In("o_orderkey", (1, 5, 42, -1))), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 42, -1)")

for _name, _entity, _fields, _filter, _from, _where in [
    ("filter_eq", "Customer", "c_custkey c_name", eq("c_mktsegment", "BUILDING"), "customer", "c_mktsegment = 'BUILDING'"),
    ("filter_ne", "Labelled", "doc_id toxic", ne("toxic", 0), _LABELLED, "toxic IS DISTINCT FROM 0"),
    ("filter_lt", "Customer", "c_custkey c_acctbal", lt("c_acctbal", 0), "customer", "c_acctbal < 0"),
    ("filter_le", "Part", "p_partkey p_size", le("p_size", 3), "part", "p_size <= 3"),
    ("filter_gt", "Order", "o_orderkey o_totalprice", gt("o_totalprice", 400000.0), "orders", "o_totalprice > 400000"),
    ("filter_ge", "Labelled", "doc_id quality", ge("quality", 1), _LABELLED, "quality >= 1"),
    ("filter_in", "Customer", "c_custkey c_mktsegment", In("c_mktsegment", ("BUILDING", "MACHINERY")), "customer", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("filter_in_null", "Labelled", "doc_id toxic", In("toxic", (1, None)), _LABELLED, "toxic = 1 OR toxic IS NULL"),
    ("filter_not_in", "Labelled", "doc_id quality", In("quality", (1,), True), _LABELLED, "NOT coalesce(quality IN (1), false)"),
    ("filter_is_null", "Labelled", "doc_id", Null("toxic"), _LABELLED, "toxic IS NULL"),
    ("filter_is_not_null", "Labelled", "doc_id toxic", Null("toxic", True), _LABELLED, "toxic IS NOT NULL"),
    ("filter_type_mismatch", "Customer", "c_custkey", Or((eq("c_acctbal", "x"), ne("c_nationkey", "3"))), "customer", "true"),
    ("filter_like_prefix", "Part", "p_partkey p_name", Like("p_name", "red%"), "part", "p_name LIKE 'red%'"),
    ("filter_like_suffix", "Part", "p_partkey p_name", Like("p_name", "%widget"), "part", "p_name LIKE '%widget'"),
    ("filter_like_contains", "Part", "p_partkey p_brand", Like("p_brand", "%#1%"), "part", "p_brand LIKE '%#1%'"),
    ("filter_like_middle", "Part", "p_partkey p_name", Like("p_name", "s%g"), "part", "p_name LIKE 's%g'"),
    ("filter_like_underscore", "Part", "p_partkey p_brand", Like("p_brand", "Brand#_"), "part", "p_brand LIKE 'Brand#_'"),
    ("filter_like_escape", "Labelled", "doc_id grade", Like("grade", r"%d\%d\oc"), _LABELLED, "grade = 'bad%doc'"),
    ("filter_not_like", "Labelled", "doc_id grade", Like("grade", "good%", True), _LABELLED, "NOT coalesce(grade LIKE 'good%', false)"),
    ("filter_and", "Customer", "c_custkey", And((gt("c_acctbal", 5000), eq("c_mktsegment", "FURNITURE"))), "customer", "c_acctbal > 5000 AND c_mktsegment = 'FURNITURE'"),
    ("filter_or", "Customer", "c_custkey", Or((lt("c_acctbal", 0), eq("c_nationkey", 7))), "customer", "c_acctbal < 0 OR c_nationkey = 7"),
    ("filter_and_empty", "Region", "r_regionkey", And(), "region", "true"),
    ("filter_or_empty", "Region", "r_regionkey", Or(), "region", "false"),
    ("filter_nested", "Customer", "c_custkey", And((Or((eq("c_nationkey", 1), eq("c_nationkey", 2))), ~eq("c_mktsegment", "BUILDING"))), "customer", "c_nationkey IN (1, 2) AND c_mktsegment <> 'BUILDING'"),
    ("filter_not", "Labelled", "doc_id", ~gt("quality", 0), _LABELLED, "NOT coalesce(quality > 0, false)"),
    ("filter_contains", "Part", "p_partkey", contains("p_name", "l r"), "part", "contains(p_name, 'l r')"),
    ("filter_starts_with", "Customer", "c_custkey", starts_with("c_name", "Customer#00000001"), "customer", "starts_with(c_name, 'Customer#00000001')"),
    ("filter_ends_with", "Customer", "c_custkey", ends_with("c_name", "7"), "customer", "ends_with(c_name, '7')"),
    ("filter_between", "Part", "p_partkey p_size", ir.between("p_size", 10, 12), "part", "p_size BETWEEN 10 AND 12"),
    ("filter_ilike", "Part", "p_partkey p_type", Like("p_type", "pro%", ignore_case=True), "part", "p_type ILIKE 'pro%'"),
]:
    _add(_name, _rows(_entity, _fields, _filter), f"SELECT {', '.join(_fields.split())} FROM {_from} WHERE {_where}")

_add("order_by_multi", _rows("Customer", "c_custkey c_mktsegment c_acctbal", order=(Order("c_mktsegment"), Order("c_acctbal", True)), limit=50), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
_add("order_by_nulls", _rows("Labelled", "doc_id toxic", order=(Order("toxic"),), limit=650), f"SELECT doc_id, toxic FROM {_LABELLED} ORDER BY toxic NULLS FIRST, doc_id LIMIT 650")
_add("order_by_nulls_desc", _rows("Labelled", "doc_id toxic", order=(Order("toxic", True),), limit=120), f"SELECT doc_id, toxic FROM {_LABELLED} ORDER BY toxic DESC NULLS LAST, doc_id LIMIT 120")
_add("limit_offset", _rows("Order", "o_orderkey o_totalprice", order=(Order("o_orderkey"),), limit=20, offset=100), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
_add("offset_beyond", _rows("Region", "r_regionkey", offset=10), "SELECT r_regionkey FROM region ORDER BY 1 OFFSET 10")
_add("top_k", _rows("Order", "o_orderkey o_totalprice", order=(Order("o_totalprice", True),), limit=10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("find_first", lambda spark, d: engine(spark, d).query("Customer").eq("c_mktsegment", "MACHINERY").select("c_custkey", "c_name").first(), "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 1")


@_query("SELECT count(*) > 10 AS has_more FROM customer WHERE c_acctbal < 0")
def has_more(spark: SparkSession, d: str) -> DataFrame:
    found = engine(spark, d).query("Customer").lt("c_acctbal", 0).limit(10).execute()
    return spark.createDataFrame([(found.has_more(),)], "has_more boolean")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 OR o_totalprice = 300000 AND o_orderkey > 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return graph.keyset_page(rows, (Order("o_totalprice", True),), ("o_orderkey",), (300000.0, 5), 15)


# -- aggregates --------------------------------------------------------------


def _aggregate(entity: str, aggregates: list[Aggregate], rounded: str = "", **more) -> Run:
    query = AggregateQuery(entity, tuple(aggregates), **more)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = engine(spark, d).aggregate(query)
        return found.withColumns({c: F.round(c, 2) for c in rounded.split()})

    return run


_add("agg_count", _aggregate("Order", [Aggregate("count", alias="n")]), "SELECT count(*) AS n FROM orders")
_add("agg_count_field", _aggregate("Labelled", [Aggregate("count", "toxic", "n")]), f"SELECT count(toxic) AS n FROM {_LABELLED}")
_add("agg_sum", _aggregate("Order", [Aggregate("sum", "o_totalprice", "total")], "total"), "SELECT round(sum(o_totalprice), 2) AS total FROM orders")
_add("agg_avg", _aggregate("Labelled", [Aggregate("avg", "quality", "mean")], "mean"), f"SELECT round(avg(CAST(quality AS DOUBLE)), 2) AS mean FROM {_LABELLED}")
_add("agg_min", _aggregate("Customer", [Aggregate("min", "c_acctbal", "low"), Aggregate("min", "c_name", "first_name")]), "SELECT min(c_acctbal) AS low, min(c_name) AS first_name FROM customer")
_add("agg_max", _aggregate("Part", [Aggregate("max", "p_size", "high")]), "SELECT max(p_size) AS high FROM part")
_add(
    "agg_multi",
    _aggregate("Lineitem", [Aggregate("count", alias="n"), Aggregate("sum", "l_quantity", "quantity"), Aggregate("avg", "l_discount", "discount"), Aggregate("max", "l_tax", "tax")], "quantity discount"),
    "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 2) AS discount, max(l_tax) AS tax FROM lineitem",
)
_add("agg_filtered", _aggregate("Order", [Aggregate("count", alias="n"), Aggregate("sum", "o_totalprice", "total")], "total", where=eq("o_orderstatus", "F")), "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
_add("agg_empty", _aggregate("Order", [Aggregate("count", alias="n"), Aggregate("sum", "o_totalprice", "total"), Aggregate("avg", "o_totalprice", "mean")], where=lt("o_totalprice", -1)), "SELECT CAST(0 AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean")
_add("group_by", _aggregate("Customer", [Aggregate("count", alias="n"), Aggregate("avg", "c_acctbal", "mean")], "mean", group_by=("c_mktsegment",)), "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1")
_add("group_by_multi", _aggregate("Lineitem", [Aggregate("count", alias="n"), Aggregate("sum", "l_quantity", "quantity")], "quantity", group_by=("l_returnflag", "l_linestatus")), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
_add("group_having", _aggregate("Order", [Aggregate("count", alias="n")], group_by=("o_custkey",), having=gt("n", 15)), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
_add("agg_count_distinct", _aggregate("Order", [Aggregate("count_distinct", "o_custkey", "customers")]), "SELECT count(DISTINCT o_custkey) AS customers FROM orders")


@_query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def group_by_date(spark: SparkSession, d: str) -> DataFrame:
    query = AggregateQuery("Order", (Aggregate("count", alias="n"),), group_by=("o_orderdate",), truncate=(("o_orderdate", "month"),))
    return engine(spark, d).aggregate(query).select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "n")


# -- includes ----------------------------------------------------------------

_SOME = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000)"
_SOME_FILTER = And((eq("c_mktsegment", "BUILDING"), gt("c_acctbal", 8000)))


def _include(path: str, part: str = "blocks", select: str = "", root: str = "Customer", where: ir.Filter | None = _SOME_FILTER, **options) -> Run:
    query = ir.GraphQuery(root, where=where, includes=(ir.Include(path, **options),))

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = getattr(engine(spark, d).execute(query), part)[path]
        return found.select(*select.split()) if select else found

    return run


_ORDERS_OF = f"FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {_SOME})"
_add("include_one_to_many", _include("orders", select="o_orderkey o_custkey o_totalprice"), f"SELECT o_orderkey, o_custkey, o_totalprice {_ORDERS_OF}")
_add("include_nested", _include("orders.items", select="l_orderkey l_linenumber l_partkey l_suppkey l_quantity"), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey {_ORDERS_OF})")
_add("include_projected", _include("orders", fields=("o_orderstatus",)), f"SELECT o_orderkey, o_orderstatus {_ORDERS_OF}")
_add("include_ordered", _include("orders", select="o_orderkey o_totalprice", order=(Order("o_totalprice", True),)), f"SELECT o_orderkey, o_totalprice {_ORDERS_OF}")
_TOP = f"(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r {_ORDERS_OF})"
_add("include_top_n_per_parent", _include("orders", select="o_orderkey o_custkey o_totalprice", order=(Order("o_totalprice", True),), limit=3), f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_TOP} WHERE r <= 3")
_add("include_offset_per_parent", _include("orders", select="o_orderkey o_custkey", order=(Order("o_totalprice", True),), limit=2, offset=1), f"SELECT o_orderkey, o_custkey FROM {_TOP} WHERE r IN (2, 3)")
_add("edge_block", _include("orders", "edges"), f"SELECT o_custkey AS from_c_custkey, o_orderkey AS to_o_orderkey {_ORDERS_OF}")
_add("edge_block_nested", _include("orders.items", "edges"), f"SELECT l_orderkey AS from_o_orderkey, l_orderkey AS to_l_orderkey, l_linenumber AS to_l_linenumber, l_partkey AS to_l_partkey, l_suppkey AS to_l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey {_ORDERS_OF})")
_add("include_one_to_one", _include("label", root="Document", where=eq("lang", "de")), "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
_add("include_many_to_one", _include("customer", select="c_custkey c_name", root="Order", where=gt("o_totalprice", 450000)), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
_add("edge_many_to_one", _include("customer", "edges", root="Order", where=gt("o_totalprice", 450000)), "SELECT o_orderkey AS from_o_orderkey, o_custkey AS to_c_custkey FROM orders WHERE o_totalprice > 450000")
_PAIRS = "SELECT DISTINCT l_partkey AS from_p_partkey, l_suppkey AS to_s_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1"
_add("include_many_to_many", _include("suppliers", "edges", root="Part", where=eq("p_size", 1)), _PAIRS)
_add("include_many_to_many_block", _include("suppliers", select="s_suppkey s_name", root="Part", where=eq("p_size", 1)), f"SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT to_s_suppkey FROM ({_PAIRS}))")
_add("include_inverse", _include("nation", select="n_nationkey n_name"), f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_SOME})")


@_query(f"SELECT o_orderkey, o_totalprice {_ORDERS_OF} AND o_totalprice > 300000")
def include_filtered(spark: SparkSession, d: str) -> DataFrame:
    query = engine(spark, d).query("Customer").where(_SOME_FILTER).include_filtered("orders", gt("o_totalprice", 300000))
    return query.execute().blocks["orders"].select("o_orderkey", "o_totalprice")


@_query(f"SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS orders FROM {_SOME} LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey GROUP BY 1")
def include_nested_objects(spark: SparkSession, d: str) -> DataFrame:
    query = ir.GraphQuery("Customer", ("c_custkey",), _SOME_FILTER, includes=(ir.Include("orders", ("o_totalprice",), gt("o_totalprice", 300000)),))
    found = graph.nested(engine(spark, d).execute(query), SCHEMA, "orders")
    return found.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"))


_FLAGSHIP = ir.GraphQuery(
    "Customer",
    where=eq("c_mktsegment", "BUILDING"),
    order=(Order("c_custkey", True),),
    limit=10,
    includes=(ir.Include("orders", order=(Order("o_totalprice", True),), limit=3), ir.Include("orders.items")),
)


@_query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 10),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN c ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey, o_totalprice, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 3
""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The newest customers of one segment, each with the three most expensive orders and those orders' lines."""
    found = engine(spark, d).execute(_FLAGSHIP)
    edges = found.edges["orders"].select(F.col("from_c_custkey").alias("c_custkey"), F.col("to_o_orderkey").alias("o_orderkey"))
    orders = found.blocks["orders"].select("o_orderkey", "o_totalprice")
    items = found.blocks["orders.items"].select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return edges.join(orders, "o_orderkey").join(items, "o_orderkey")


# -- search ------------------------------------------------------------------

_VECTOR = tuple(round(math.sin(k + 1), 4) for k in range(64))
_VECTOR_SQL = f"CAST([{', '.join(map(str, _VECTOR))}] AS DOUBLE[])"
_DISTANCES = {
    "cosine": f"1 - list_inner_product(e, {_VECTOR_SQL}) / sqrt(list_inner_product(e, e) * list_inner_product({_VECTOR_SQL}, {_VECTOR_SQL}))",
    "euclidean": f"sqrt(list_inner_product(e, e) - 2 * list_inner_product(e, {_VECTOR_SQL}) + list_inner_product({_VECTOR_SQL}, {_VECTOR_SQL}))",
    "dot": f"-list_inner_product(e, {_VECTOR_SQL})",
}


def _near(metric: str, k: int, most: float | None = None) -> Run:
    query = ir.GraphQuery("Embedding", ("label",), ir.VectorNear("embedding", _VECTOR, k, most, metric))
    return lambda spark, d: engine(spark, d).execute(query).root.withColumn("_distance", F.round("_distance", 4)).withColumnRenamed("_distance", "distance")


for _metric, _distance in _DISTANCES.items():
    _add(f"vector_knn_{_metric}", _near(_metric, 10), f"SELECT vec_id, label, round({_distance}, 4) AS distance FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) ORDER BY {_distance}, vec_id LIMIT 10")
_add("vector_knn_threshold", _near("cosine", 50, 0.85), f"SELECT vec_id, label, round({_DISTANCES['cosine']}, 4) AS distance FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE {_DISTANCES['cosine']} <= 0.85 ORDER BY {_DISTANCES['cosine']}, vec_id LIMIT 50")


@_query()
def vector_knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    what = ir.VectorNear("embedding", _VECTOR, 10)
    return search.nearest_vectors_lsh(load(spark, d, "embeddings"), what, ("vec_id",)).select("vec_id", "label")


_PLACES = "(SELECT c_custkey, c_mktsegment, (c_custkey * 37 % 1800) / 10.0 - 90.0 AS lat, (c_custkey * 91 % 3600) / 10.0 - 180.0 AS lon FROM customer)"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(40.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(-20.0) - radians(lon)) / 2), 2))))"
_TRIANGLE = ((10.0, -100.0), (60.0, 20.5), (-30.0, 90.0))
_CROSSINGS = " + ".join(
    f"CASE WHEN ({a[0]} > lat) <> ({b[0]} > lat) AND lon < ({b[1]} - {a[1]}) * (lat - {a[0]}) / ({b[0]} - {a[0]}) + {a[1]} THEN 1 ELSE 0 END" for a, b in zip(_TRIANGLE, [*_TRIANGLE[1:], _TRIANGLE[0]])
)
_add("geo_radius", _rows("Place", "c_custkey", ir.GeoRadius("location", 40.0, -20.0, 3000.0)), f"SELECT c_custkey FROM {_PLACES} WHERE {_KM} <= 3000")
_add("geo_box", _rows("Place", "c_custkey", ir.GeoBox("location", -10.0, 20.0, 35.0, 80.0)), f"SELECT c_custkey FROM {_PLACES} WHERE lat BETWEEN -10 AND 35 AND lon BETWEEN 20 AND 80")
_add("geo_polygon", _rows("Place", "c_custkey", ir.GeoPolygon("location", _TRIANGLE)), f"SELECT c_custkey FROM {_PLACES} WHERE ({_CROSSINGS}) % 2 = 1")
_add("geo_and_filter", _rows("Place", "c_custkey", And((ir.GeoBox("location", -10.0, 20.0, 35.0, 80.0), eq("c_mktsegment", "BUILDING")))), f"SELECT c_custkey FROM {_PLACES} WHERE lat BETWEEN -10 AND 35 AND lon BETWEEN 20 AND 80 AND c_mktsegment = 'BUILDING'")


@_query(f"SELECT c_custkey, round({_KM}, 4) AS distance FROM {_PLACES} ORDER BY {_KM}, c_custkey LIMIT 20")
def geo_nearest(spark: SparkSession, d: str) -> DataFrame:
    found = engine(spark, d).execute(ir.GraphQuery("Place", ("c_custkey",), ir.GeoNear("location", 40.0, -20.0, 20))).root
    return found.select("c_custkey", F.round("_distance", 4).alias("distance"))


_TERMS = r"(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 2) AS t FROM documents)"
_BM25 = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * dl / mean))"
_STATS = f"s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {_TERMS})"


def _text(what: ir.Filter, limit: int | None = None) -> Run:
    """Scores as they are returned decide the order, and so which rows of one rounded score are within the limit: those of the smallest ids."""
    query = ir.GraphQuery("Document", ("doc_id",), what)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = engine(spark, d).execute(query).root.select("doc_id", F.round("_score", 4).alias("score"))
        return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)

    return run


def _scores(terms: list[str]) -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {_STATS}, q(w) AS (VALUES {wanted}),
p AS (SELECT doc_id, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS dl FROM {_TERMS}, q),
f AS (SELECT w, count(*) AS df FROM p WHERE tf > 0 GROUP BY w),
m AS (SELECT doc_id, sum({_BM25}) AS score FROM p JOIN f USING (w), s WHERE tf > 0 GROUP BY doc_id)"""


_add("text_match", _text(ir.TextMatch("text", "thing hashe und der", config="precise"), 1000), f"{_scores(['thing', 'hashe', 'und', 'der'])} SELECT doc_id, round(score, 4) AS score FROM m ORDER BY score DESC, doc_id LIMIT 1000")
_add("text_match_min_score", _text(ir.TextMatch("text", "und der", 1.0, "precise"), 1000), f"{_scores(['und', 'der'])} SELECT doc_id, round(score, 4) AS score FROM m WHERE score >= 1.0 ORDER BY score DESC, doc_id LIMIT 1000")
_add(
    "text_boolean",
    _text(ir.TextBoolean("text", ("the", "and"), ("that",), ("und",), "precise"), 1000),
    f"{_scores(['the', 'and', 'that'])} SELECT doc_id, round(score, 4) AS score FROM m JOIN {_TERMS} d USING (doc_id) WHERE list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'und') ORDER BY score DESC, doc_id LIMIT 1000",
)
_add(
    "text_phrase",
    _text(ir.TextPhrase("text", "of the", "precise")),
    f"""WITH {_STATS}, p AS (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM {_TERMS}),
f AS (SELECT count(*) FILTER (WHERE list_contains(t, 'of')) AS a, count(*) FILTER (WHERE list_contains(t, 'the')) AS b FROM {_TERMS})
SELECT doc_id, round((ln((n - a + 0.5) / (a + 0.5) + 1) + ln((n - b + 0.5) / (b + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * dl / mean)), 4) AS score FROM p, f, s WHERE tf > 0""",
)
_add("text_match_stemmed", _text(ir.TextMatch("text", "license licensed works")))
_add("text_tokens", lambda spark, d: load(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("words")), f"SELECT doc_id, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT doc_id, unnest(t) AS w FROM {_TERMS}) GROUP BY 1")
_add(
    "text_postings",
    lambda spark, d: search.postings(load(spark, d, "documents"), "text", ("doc_id",), "precise"),
    r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 2) AS t FROM documents), p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term, unnest(range(0, len(t))) AS position FROM t) SELECT term, doc_id, CAST(length AS INT) AS length, count(*) AS tf, CAST(min(position) AS INT) AS first_position FROM p GROUP BY 1, 2, 3",
)
_add(
    "text_idf",
    lambda spark, d: search.term_idf(load(spark, d, "documents"), "text", "precise").withColumn("idf", F.round("idf", 4)),
    f"WITH {_STATS}, w AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM {_TERMS}) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 4) AS idf FROM w, s GROUP BY term",
)

# -- query language ----------------------------------------------------------


def _said(source: str, part: Callable[[object], DataFrame] = lambda found: found.root) -> Run:
    return lambda spark, d: part(language.run(engine(spark, d), source))


_add("dsl_find_many", _said('Customer.findMany().where(c_mktsegment == "BUILDING" && c_acctbal > 9000.5).orderBy(c_acctbal.desc).limit(10)'), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000.5 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_add("dsl_find_first", _said('Customer.findFirst().where(c_name like "%9")'), "SELECT * FROM customer WHERE c_name LIKE '%9' ORDER BY c_custkey LIMIT 1")
_add("dsl_find_unique", _said("Nation.findUnique().where(n_nationkey == 7)"), "SELECT * FROM nation WHERE n_nationkey = 7")
_add("dsl_count", _said("Labelled.count().where(toxic is not null || n_chars < 100)", lambda found: found), f"SELECT count(*) AS count FROM {_LABELLED} WHERE toxic IS NOT NULL OR n_chars < 100")
_add("dsl_include", _said("Region.findMany().where(r_regionkey in [1, 3]).include(nations)", lambda found: found.blocks["nations"]), "SELECT * FROM nation WHERE n_regionkey IN (1, 3)")

# -- security ----------------------------------------------------------------

_READER = security.Context.of("ann", "read:*", nation=7, nations=[1, 2])


def _secured(policies: tuple, query: ir.GraphQuery, part: Callable = lambda found: found.root) -> Run:
    return lambda spark, d: part(engine(spark, d, policies=policies).execute(query, _READER))


_CUSTOMERS = ir.GraphQuery("Customer", ("c_custkey", "c_nationkey"))
_add("rls_permissive", _secured((security.Policy("Customer", security.AttributeEq("c_nationkey", "nation")), security.Policy("Customer", gt("c_acctbal", 9000))), _CUSTOMERS), "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7 OR c_acctbal > 9000")
_add(
    "rls_restrictive",
    _secured((security.Policy("Customer", security.AttributeEq("c_nationkey", "nations")), security.Policy("Customer", Or((lt("c_acctbal", 0), gt("c_acctbal", 5000))), False)), replace(_CUSTOMERS, where=Or((eq("c_mktsegment", "BUILDING"), eq("c_mktsegment", "MACHINERY"))))),
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2) AND (c_acctbal < 0 OR c_acctbal > 5000) AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_add("rls_fail_closed", _secured((security.Policy("Customer", security.AttributeEq("c_nationkey", "absent")),), _CUSTOMERS), "SELECT c_custkey, c_nationkey FROM customer WHERE false")
_add("rls_include", _secured((security.Policy("Customer", gt("c_acctbal", 0), False),), ir.GraphQuery("Nation", includes=(ir.Include("customers", ("c_acctbal",)),)), lambda found: found.blocks["customers"]), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")


@_query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0")
def rls_aggregate(spark: SparkSession, d: str) -> DataFrame:
    query = AggregateQuery("Customer", (Aggregate("count", alias="n"), Aggregate("sum", "c_acctbal", "total")))
    found = engine(spark, d, policies=(security.Policy("Customer", gt("c_acctbal", 0)),)).aggregate(query, _READER)
    return found.withColumn("total", F.round("total", 2))


def _masked(how: tuple, name: str = "c_name") -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = engine(spark, d)
        fields = tuple(replace(f, access="restricted", mask=how) if f.name == name else f for f in SCHEMA.entity("Customer").fields)
        own.schema = replace(SCHEMA, entities=SCHEMA.entities | {"Customer": replace(SCHEMA.entity("Customer"), fields=fields)})
        return own.execute(ir.GraphQuery("Customer", ("c_custkey", name)), _READER).root

    return run


_add("mask_omit", _masked(("omit",)), "SELECT c_custkey FROM customer")
_add("mask_null", _masked(("null",)), "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
_add("mask_redacted", _masked(("redacted", "[hidden]")), "SELECT c_custkey, '[hidden]' AS c_name FROM customer")
_add("mask_partial", _masked(("partial", 4, True, "*")), "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name FROM customer")
_add("mask_partial_start", _masked(("partial", 3, False, "#"), "c_mktsegment"), "SELECT c_custkey, left(c_mktsegment, 3) || repeat('#', length(c_mktsegment) - 3) AS c_mktsegment FROM customer")
_add("mask_hash", _masked(("hash",)), "SELECT c_custkey, 'hash:' || sha256(c_name) AS c_name FROM customer")


@_query("SELECT count(*) > 50 AS exceeded FROM customer")
def budget_guard(spark: SparkSession, d: str) -> DataFrame:
    context = replace(_READER, budget=security.Budget(2, 50, 10), enforce_budget=True)
    try:
        engine(spark, d).execute(_CUSTOMERS, context)
        exceeded = False
    except security.BudgetExceeded:
        exceeded = True
    return spark.createDataFrame([(exceeded,)], "exceeded boolean")


# -- history, mutations, constraints -----------------------------------------

_HISTORY = "(SELECT user_id AS id, event_type, value, event_id AS version_ts, event_id % 7 = 0 AS deleted FROM events)"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("version_ts"), (F.col("event_id") % 7 == 0).alias("deleted"))


def _newest(source: str) -> str:
    return f"SELECT id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_ts DESC) AS r FROM {source}) WHERE r = 1 AND NOT deleted"


_add("latest_view", lambda spark, d: store.latest_view(_history(spark, d), ("id",)), _newest(_HISTORY))
_add("snapshot_as_of", lambda spark, d: store.as_of(_history(spark, d), ("id",), 500), _newest(f"{_HISTORY} WHERE version_ts <= 500"))
_add("version_history", lambda spark, d: store.versions(_history(spark, d), F.col("id") == 8), f"SELECT * FROM {_HISTORY} WHERE id = 8")
_add("get_by_ids", lambda spark, d: store.get(_history(spark, d), ("id",), [(8,), (9,), (46,), (-1,)]), f"SELECT * FROM ({_newest(_HISTORY)}) WHERE id IN (8, 9, 46, -1)")
_add(
    "compact_versions",
    lambda spark, d: store.compacted(_history(spark, d), ("id",), 3, 900, 990),
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_ts DESC) AS r FROM {_HISTORY}) SELECT id, event_type, value, version_ts, deleted FROM r WHERE (r <= 3 OR version_ts >= 900) AND id NOT IN (SELECT id FROM r WHERE r = 1 AND deleted AND version_ts < 990)",
)
_VIEW = "(SELECT c_custkey, c_mktsegment, c_acctbal FROM customer)"


def _view(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


def _patch(spark: SparkSession, d: str) -> DataFrame:
    """One segment moved, rows of another as they are, and new rows."""
    rows, key = _view(spark, d), F.col("c_custkey")
    moved = rows.where("c_mktsegment = 'MACHINERY'").select(key, F.lit("MOVED").alias("c_mktsegment"))
    same = rows.where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(key, "c_mktsegment")
    return moved.unionByName(same).unionByName(rows.where("c_acctbal > 9000").select((key + 1_000_000_000_000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))


def _now() -> Column:
    return F.lit(7).cast("long")


_PATCH = "(SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' OR (c_mktsegment = 'BUILDING' AND c_acctbal < 0) UNION ALL SELECT c_custkey + 1000000000000, 'NEW' FROM customer WHERE c_acctbal > 9000)"
_STAMP = "CAST(7 AS BIGINT) AS version_ts"
_add("apply_inserts", lambda spark, d: store.inserted(_view(spark, d), _now()), f"SELECT *, {_STAMP}, false AS deleted FROM {_VIEW}")
_add("apply_updates", lambda spark, d: store.updated(_view(spark, d), _patch(spark, d), ("c_custkey",), _now()), f"SELECT c_custkey, p.c_mktsegment, c_acctbal, {_STAMP}, false AS deleted FROM {_VIEW} JOIN {_PATCH} p USING (c_custkey)")
_add("apply_deletes", lambda spark, d: store.deleted(_view(spark, d), _patch(spark, d), ("c_custkey",), _now()), f"SELECT *, {_STAMP}, true AS deleted FROM {_VIEW} WHERE c_custkey IN (SELECT c_custkey FROM {_PATCH})")
_add("apply_upserts", lambda spark, d: store.upserted(_view(spark, d), _patch(spark, d), ("c_custkey",), _now()), f"SELECT c_custkey, p.c_mktsegment, c_acctbal, {_STAMP}, false AS deleted FROM {_PATCH} p LEFT JOIN {_VIEW} USING (c_custkey)")
_add("update_where", lambda spark, d: store.updated_where(_view(spark, d), lt("c_acctbal", 0), {"c_acctbal": F.lit(0.0)}, _now()), f"SELECT c_custkey, c_mktsegment, CAST(0 AS DOUBLE) AS c_acctbal, {_STAMP}, false AS deleted FROM {_VIEW} WHERE c_acctbal < 0")
_add("delete_where", lambda spark, d: store.deleted_where(_view(spark, d), eq("c_mktsegment", "BUILDING"), _now()), f"SELECT *, {_STAMP}, true AS deleted FROM {_VIEW} WHERE c_mktsegment = 'BUILDING'")
_add("changed_fields", lambda spark, d: store.changed_fields(_view(spark, d), _patch(spark, d), ("c_custkey",)).select("c_custkey", F.array_join("changed", ",").alias("changed")), f"SELECT c_custkey, CASE WHEN v.c_mktsegment = p.c_mktsegment THEN '' ELSE 'c_mktsegment' END AS changed FROM {_VIEW} v JOIN {_PATCH} p USING (c_custkey)")
_add("check_unique", lambda spark, d: constraints.unique_violations(load(spark, d, "lineitem"), ("l_orderkey", "l_linenumber")), "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
_add("check_foreign_key", lambda spark, d: constraints.foreign_key_violations(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ("o_custkey",), load(spark, d, "customer").where("c_custkey >= 10"), ("c_custkey",)), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey >= 10)")
_add("check_expression", lambda spark, d: constraints.check_violations(load(spark, d, "part").select("p_partkey", "p_size", "p_type"), "p_size >= 5 AND (p_type IN ('PROMO', 'SMALL') OR NOT p_size > 40)"), "SELECT p_partkey, p_size, p_type FROM part WHERE NOT (p_size >= 5 AND (p_type IN ('PROMO', 'SMALL') OR NOT p_size > 40))")


@_query("SELECT 'Region' AS entity, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'Nation', n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    own = engine(spark, d)
    doomed = constraints.cascade(SCHEMA, own.tables, "Region", own.tables["Region"].where("r_regionkey = 1"))
    parts = [rows.select(F.lit(name).alias("entity"), F.col(SCHEMA.entity(name).identity[0]).cast("long").alias("id")) for name, rows in doomed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_query("SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS s_nationkey FROM supplier")
def set_null_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "nation").where("n_nationkey = 3")
    return constraints.nulled(gone, SCHEMA.relation("Nation", "suppliers"), load(spark, d, "supplier")).select("s_suppkey", "s_nationkey")


@_query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1")
def restrict_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a restricting relation keeps from being deleted."""
    doomed = load(spark, d, "customer").where("c_acctbal < 0")
    held = constraints.referring(doomed, SCHEMA.relation("Customer", "orders"), load(spark, d, "orders"))
    return held.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


# -- operators that give tables of few rows, sinks and transactions -----------


def _values(columns: str, rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


@_query(_values("tier, depth, entities, edges", [("default", 5, 10000, 50000), ("anonymous", 2, 100, 500), ("authenticated", 5, 10000, 50000), ("privileged", 10, 100000, 500000), ("admin", 20, 1000000, 5000000)]))
def budget_tiers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(name, b.depth, b.entities, b.edges) for name, b in security.BUDGETS.items()], "tier string, depth int, entities int, edges int")


@_query("SELECT n_name, n_name LIKE 'NATION\\_1%' ESCAPE '\\' OR n_name = 'NATION_5' AS readable FROM nation")
def capability_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Which names two capabilities cover."""
    own = [security.Capability.parse(x) for x in ("read:NATION_1*", "read:NATION_5")]
    names = load(spark, d, "nation").select("n_name")
    covered = [F.col("n_name").startswith(c.scope[:-1]) if c.scope.endswith("*") else F.col("n_name") == c.scope for c in own]
    return names.select("n_name", (covered[0] | covered[1]).alias("readable"))


@_query(f"SELECT * FROM ({_newest(_HISTORY)}) WHERE event_type <> 'click'")
def transaction_view(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction sees after it has deleted all rows of one type."""
    own = store.Transaction(_history(spark, d), ("id",))
    seen = own.view()
    own.delete(seen.where("event_type = 'click'").select("id"), F.lit(10**15).cast("long"))
    return own.view()


def _reread(kind: str) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found, folder = language.run(engine(spark, d), "Customer.findMany().where(c_acctbal > 0)"), fresh_path(spark, f"sink-{kind}")
        sinks.write_result(found, folder, kind)
        reader = spark.read.schema(found.root.schema)
        return reader.csv(f"{folder}/root", header=True) if kind == "csv" else getattr(reader, kind)(f"{folder}/root")

    return run


for _kind in ("parquet", "json", "csv"):
    _add(f"sink_{_kind}", _reread(_kind), "SELECT * FROM customer WHERE c_acctbal > 0")


@_query("SELECT * FROM supplier")
def backup_and_restore(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(spark, "backup")
    sinks.backup({"supplier": load(spark, d, "supplier")}, folder, 7)
    return sinks.restore(spark, folder, "supplier", 7)


_add("dsl_repeated_where", _said('Customer.findMany().where(c_acctbal > 5000.0).where(c_mktsegment == "BUILDING")'), "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
_add("dsl_offset", _said("Nation.findMany().orderBy(n_name.asc).offset(20)"), "SELECT * FROM nation ORDER BY n_name, n_nationkey OFFSET 20")


@_query(_values("what, place, grade", [("entity_removed", "Region", "D"), ("relation_removed", "Region.nations", "D"), ("field_added", "Nation.n_code", "A")]))
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changes between two schemas, and their grades."""
    nation = SCHEMA.entity("Nation")
    old = replace(SCHEMA, entities={n: SCHEMA.entities[n] for n in ("Region", "Nation")}, relations={k: r for k, r in SCHEMA.relations.items() if k == ("Region", "nations")}, constraints=())
    new = replace(old, entities={"Nation": replace(nation, fields=(*nation.fields, replace(nation.field("n_name"), name="n_code", required=False, default=None)))}, relations={})
    return spark.createDataFrame([(c.what, c.where, migration.grade(c, new)) for c in migration.diff(old, new)], "what string, place string, grade string")


# -- changes -----------------------------------------------------------------

_LOG = "(SELECT event_id + 1 AS lsn, event_type AS entity, user_id AS id, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op, value FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, "delete").when(F.col("event_id") % 5 == 1, "insert").otherwise("update")
    return load(spark, d, "events").select((F.col("event_id") + 1).alias("lsn"), F.col("event_type").alias("entity"), F.col("user_id").alias("id"), kind.alias("op"), "value")


_add("cdc_batch", lambda spark, d: changes.batch(_log(spark, d), 101, 50).rows, f"SELECT * FROM {_LOG} WHERE lsn >= 101 ORDER BY lsn LIMIT 50")
_add("cdc_filtered", lambda spark, d: changes.batch(_log(spark, d), 10, 40, ("click", "view")).rows, f"SELECT * FROM {_LOG} WHERE lsn >= 10 AND entity IN ('click', 'view') ORDER BY lsn LIMIT 40")
_add("cdc_next_lsn", lambda spark, d: changes.batch(_log(spark, d), 10, 40, ("click",)).next_lsn(), f"SELECT max(lsn) + 1 AS next_lsn FROM (SELECT * FROM {_LOG} WHERE lsn >= 10 AND entity = 'click' ORDER BY lsn LIMIT 40)")
_add("cdc_truncate", lambda spark, d: changes.truncated(_log(spark, d), 900), f"SELECT * FROM {_LOG} WHERE lsn >= 900")
_add("cdc_apply", lambda spark, d: changes.applied(_log(spark, d)), f"SELECT entity, id, lsn, op, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, id ORDER BY lsn DESC) AS r FROM {_LOG}) WHERE r = 1 AND op <> 'delete'")
_add("cdc_status", lambda spark, d: changes.status(_log(spark, d), 400), f"SELECT max(lsn) AS current_lsn, max(lsn) - 400 AS lag_entries FROM {_LOG}")


@_query(f"SELECT lsn, id, value FROM {_LOG} WHERE entity = 'purchase' AND value > 20")
def stream_subscription(spark: SparkSession, d: str) -> DataFrame:
    """A subscription to one entity's changes, delivered once by a stream that stops when it has caught up."""
    log, path, out = _log(spark, d), fresh_path(spark, "log"), fresh_path(spark, "delivered")
    log.write.parquet(path)
    stream = changes.subscription(spark, path, log.schema, "purchase", gt("value", 20.0), ("lsn", "id", "value"))
    changes.deliver(stream, fresh_path(spark, "subscription"), out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# -- migration ---------------------------------------------------------------

_add("backfill_default", lambda spark, d: migration.backfill_default(load(spark, d, "nation"), "tier", F.lit("basic")), "SELECT *, 'basic' AS tier FROM nation")
_add("backfill_nulls", lambda spark, d: migration.backfill_nulls(engine(spark, d).tables["Labelled"].select("doc_id", "toxic"), "toxic", F.lit(0)), f"SELECT doc_id, coalesce(toxic, 0) AS toxic FROM {_LABELLED}")
_add("backfill_copy_cast", lambda spark, d: migration.copy_field(load(spark, d, "part").select("p_partkey", "p_size"), "p_size", "size64", "bigint"), "SELECT p_partkey, p_size, CAST(p_size AS BIGINT) AS size64 FROM part")
_add("backfill_compute", lambda spark, d: migration.compute_field(load(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "label", "concat(p_brand, '/', lower(p_type))"), "SELECT p_partkey, p_brand, p_type, p_brand || '/' || lower(p_type) AS label FROM part")


@_query("SELECT entity, rows FROM (SELECT 'Customer' AS entity, count(*) AS rows FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part)")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    own = engine(spark, d)
    counts = [own.tables[name].agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("rows")) for name in ("Customer", "Order", "Part")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
