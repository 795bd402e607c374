"""The sample tables as entities of one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.operators.graph import Engine
from entigraph.plans.model import Entity, Field, Relation, Schema, optional, scalar


def _entity(name: str, identity: str, **fields: str) -> Entity:
    made = tuple(Field(f, optional(t[1:]) if t[0] == "?" else scalar(t), required=t[0] != "?") for f, t in fields.items())
    return Entity(name, tuple(identity.split()), made)


_I, _L, _D, _S, _T = "int32", "int64", "float64", "string", "timestamp"
ENTITIES = [
    _entity("Region", "r_regionkey", r_regionkey=_I, r_name=_S),
    _entity("Nation", "n_nationkey", n_nationkey=_I, n_name=_S, n_regionkey=_I),
    _entity("Customer", "c_custkey", c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    _entity("Supplier", "s_suppkey", s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    _entity("Part", "p_partkey", p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    _entity("Order", "o_orderkey", o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_T, o_orderpriority=_S),
    _entity(
        "Lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
        l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_T,
    ),
    _entity("Event", "event_id", event_id=_L, ts=_T, user_id=_L, event_type=_S, value=_D, props=_S),
    _entity("Document", "doc_id", doc_id=_L, text="text", lang=_S, source=_S, n_chars=_L),
    _entity("Label", "doc_id", doc_id=_L, quality=_I, toxic=_I),
    _entity("Labelled", "doc_id", doc_id=_L, lang=_S, n_chars=_L, quality="?int32", toxic="?int32", grade="?string"),
    _entity("Embedding", "vec_id", vec_id=_L, embedding="vector", label=_I),
    _entity("Place", "c_custkey", c_custkey=_L, c_mktsegment=_S, location="geo_point"),
]


def _relation(name: str, source: str, own: str, target: str, other: str, **more) -> Relation:
    return Relation(name, source, (own,), target, (other,), **more)


RELATIONS = [
    _relation("nations", "Region", "r_regionkey", "Nation", "n_regionkey", on_delete="cascade"),
    _relation("customers", "Nation", "n_nationkey", "Customer", "c_nationkey", on_delete="cascade"),
    _relation("suppliers", "Nation", "n_nationkey", "Supplier", "s_nationkey", on_delete="set_null"),
    _relation("orders", "Customer", "c_custkey", "Order", "o_custkey"),
    _relation("items", "Order", "o_orderkey", "Lineitem", "l_orderkey"),
    _relation("customer", "Order", "o_custkey", "Customer", "c_custkey", cardinality="many_to_one"),
    _relation("label", "Document", "doc_id", "Label", "doc_id", cardinality="one_to_one"),
    _relation("suppliers", "Part", "p_partkey", "Supplier", "s_suppkey", cardinality="many_to_many", edge_entity="Lineitem", edge_from=("l_partkey",), edge_to=("l_suppkey",)),
]
RELATIONS.append(RELATIONS[1].inverse("nation"))
SCHEMA = Schema.of(ENTITIES, RELATIONS)
_FILES = {"Order": "orders", "Labelled": "", "Place": ""} | {e.name: f"{e.name.lower()}s" for e in ENTITIES if e.name in ("Event", "Document", "Label", "Embedding")}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any: the sample's only nulls."""
    joined = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    grade = F.when(F.col("quality") == 1, "good_doc").when(F.col("quality") == 0, "bad%doc")
    return joined.withColumn("grade", grade)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at coordinates that their keys give."""
    key = F.col("c_custkey")
    at = F.struct((key * 37 % 1800 / 10.0 - 90.0).alias("lat"), (key * 91 % 3600 / 10.0 - 180.0).alias("lon"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", at.alias("location"))


class _Tables(dict):
    """Tables that are opened when a query asks for them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        special = {"Labelled": labelled, "Place": places}.get(name)
        self[name] = special(self.spark, self.sf_dir) if special else load(self.spark, self.sf_dir, _FILES.get(name, name.lower()))
        return self[name]


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(SCHEMA, _Tables(spark, sf_dir), **options)
