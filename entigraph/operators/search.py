"""Ranked search over an entity's rows: nearest vectors and places, and BM25 text search.

All searches are exact scans: a distance or score column, a filter, and a
top-k that Spark takes per task before it merges (no full sort, no shuffle of
rows).  Text search takes corpus statistics in one aggregate over the rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.functions import geo, text, vector
from entigraph.plans import ir
from entigraph.plans.model import Entity
from entigraph.plans.workspace import worker_path



def ranked(rows: DataFrame, what: ir.Ranking, entity: Entity) -> tuple[DataFrame, list[Column]]:
    """Matching rows with their distance or score, and the sort keys of relevance."""
    if isinstance(what, ir.VectorNear):
        return nearest_vectors(rows, what, entity.identity, entity.field(what.field).type.dimensions), [F.col("_distance").asc()]
    if isinstance(what, ir.GeoNear):
        near = rows.withColumn("_distance", geo.distance(F.col(what.field), what.lat, what.lon)).where("_distance is not null")
        return _top(near, what.k, entity.identity), [F.col("_distance").asc()]
    return text_search(rows, what), [F.col("_score").desc()]


def _top(rows: DataFrame, k: int, identity: tuple[str, ...]) -> DataFrame:
    return rows.orderBy(F.col("_distance").asc(), *identity).limit(k)


def nearest_vectors(rows: DataFrame, what: ir.VectorNear, identity: tuple[str, ...], dimensions: int = 0) -> DataFrame:
    if dimensions and dimensions != len(what.vector):
        raise ValueError(f"the query has {len(what.vector)} dimensions, the field {dimensions}")
    near = rows.withColumn("_distance", vector.distance(F.col(what.field), what.vector, what.metric)).where("_distance is not null")
    if what.max_distance is not None:
        near = near.where(F.col("_distance") <= float(what.max_distance))
    return _top(near, what.k, identity)


def nearest_vectors_lsh(rows: DataFrame, what: ir.VectorNear, identity: tuple[str, ...], length: float = 2.0, tables: int = 8) -> DataFrame:
    """Approximate Euclidean neighbours by random projections: hash tables narrow the rows before distances are taken."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    usable = rows.where(F.size(what.field) == len(what.vector)).withColumn("_vector", array_to_vector(F.col(what.field).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_vector", outputCol="_hashes", bucketLength=length, numHashTables=tables, seed=11).fit(usable)
    found = model.approxNearestNeighbors(usable, Vectors.dense(what.vector), what.k, distCol="_distance")
    return found.drop("_vector", "_hashes").orderBy("_distance", *identity).limit(what.k)


# -- text --------------------------------------------------------------------


def postings(rows: DataFrame, field: str, identity: tuple[str, ...], config: str = "default") -> DataFrame:
    """The inverted index as a table: term, identity, tf, first position and length of the row's text."""
    worker_path(rows.sparkSession)
    own = rows.select(*identity, text.analyzed(F.col(field), text.CONFIGS[config]).alias("_terms"))
    placed = own.select(*identity, F.size("_terms").alias("length"), F.posexplode("_terms").alias("position", "term"))
    return placed.groupBy("term", *identity, "length").agg(F.count(F.lit(1)).alias("tf"), F.min("position").alias("first_position"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_idf(rows: DataFrame, field: str, config: str = "default") -> DataFrame:
    """Document frequency and idf of every term; texts without terms count as documents."""
    worker_path(rows.sparkSession)
    own = rows.select(F.array_distinct(text.analyzed(F.col(field), text.CONFIGS[config])).alias("_terms"))
    df = own.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = own.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return df.join(F.broadcast(n), F.lit(True)).select("term", "df", idf(F.col("df"), F.col("_n")).alias("idf"))


def _count(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == F.lit(term)))


def _phrase_count(terms: Column, phrase: list[str]) -> Column:
    places = F.sequence(F.lit(0), F.greatest(F.size(terms) - len(phrase), F.lit(0)))
    at = lambda i: functools.reduce(operator.and_, [F.coalesce(F.get(terms, i + k) == F.lit(t), F.lit(False)) for k, t in enumerate(phrase)])
    return F.size(F.filter(places, at))


def text_search(rows: DataFrame, what: ir.TextMatch | ir.TextPhrase | ir.TextBoolean) -> DataFrame:
    """Rows that match, with ``_score``; statistics are over all rows given."""
    worker_path(rows.sparkSession)
    config = text.CONFIGS[what.config]
    must, should, never, phrase = [], [], [], []
    if isinstance(what, ir.TextBoolean):
        must, should, never = ([t for q in part for t in text.analyzed_list(q, config)] for part in (what.must, what.should, what.must_not))
    elif isinstance(what, ir.TextPhrase):
        phrase = text.analyzed_list(what.phrase, config)
    else:
        should = text.analyzed_list(what.query, config)  # a repeated term counts twice
    scored = must + should + phrase
    if not scored:
        return rows.where(F.lit(False)).withColumn("_score", F.lit(0.0))
    names = list(dict.fromkeys(scored + never))

    def measured(terms: Column) -> Column:
        tf = [_count(terms, t).alias(f"tf{k}") for k, t in enumerate(names)]
        return F.struct(F.size(terms).alias("length"), *tf, _phrase_count(terms, phrase or [""]).alias("phrase"))

    # All that is needed of a text in one expression over a bound variable, so that its analysis runs once.
    own = rows.withColumn("_m", F.transform(F.array(text.analyzed(F.col(what.field), config)), measured)[0])
    tf = {t: F.col(f"_m.tf{k}") for k, t in enumerate(names)}
    held = [F.count(F.when(tf[t] > 0, 1)).cast("double").alias(f"_df{k}") for k, t in enumerate(names)]
    # One row of statistics, joined by broadcast so that the plan stays lazy.  Rows without a text count, but have no length.
    mean = F.avg(F.when(F.col(what.field).isNotNull(), F.col("_m.length")))
    stats = own.agg(F.count(F.lit(1)).cast("double").alias("_n"), mean.alias("_mean"), *held)
    joined = own.join(F.broadcast(stats), F.lit(True))
    length = F.col("_m.length") / F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)
    weight = {t: idf(F.col(f"_df{k}"), F.col("_n")) for k, t in enumerate(names)}

    def bm25(count: Column, weighs: Column) -> Column:
        return weighs * count * (config.k1 + 1) / (count + config.k1 * (1 - config.b + config.b * length))

    if phrase:
        hit = F.col("_m.phrase") > 0
        score = bm25(F.col("_m.phrase"), functools.reduce(operator.add, [weight[t] for t in phrase]))
    else:
        hit = functools.reduce(operator.and_, [tf[t] > 0 for t in must]) if must else functools.reduce(operator.or_, [tf[t] > 0 for t in should])
        for t in never:
            hit &= tf[t] == 0
        score = functools.reduce(operator.add, [bm25(tf[t], weight[t]) for t in scored])
    # Told by the statistics too, the condition stays above the join instead of running the analysis once more below it.
    found = joined.withColumn("_score", score).where(F.when(F.col("_n") > 0, hit))
    if isinstance(what, ir.TextMatch) and what.min_score > 0:
        found = found.where(F.col("_score") >= float(what.min_score))
    return found.select(*rows.columns, "_score")
