"""Search, security, history, constraints, changes and migration."""

import pytest
from pyspark.sql import functions as F

from entigraph.functions import geo, text, vector
from entigraph.functions.stemmer import stem
from entigraph.operators import constraints, migration, search, security, store
from entigraph.plans import ir
from entigraph.plans.model import Entity, Field, Relation, Schema, enum, optional, scalar
from entigraph.sources import sinks
from entigraph.streaming import changes


@pytest.mark.parametrize(
    "word, want",
    [
        ("cats", "cat"), ("ponies", "poni"), ("caresses", "caress"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("running", "run"), ("singing", "sing"),
        ("conflating", "conflat"), ("relational", "relat"), ("conditional", "condit"), ("happiness", "happi"), ("connections", "connect"), ("a", "a"), ("", ""), ("the", "the"), ("lazy", "lazi"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_analysis(spark):
    assert text.analyzed_list("The quick brown fox is jumping over the lazy dogs", text.CONFIGS["default"]) == ["quick", "brown", "fox", "jump", "over", "lazi", "dog"]
    rows = spark.createDataFrame([("Running dogs are happy ä x",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.analyzed(F.col("t"), text.CONFIGS["default"])).collect()] == [["run", "dog", "happi", "ä"], []]


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(1, "Rust programming language"), (2, "Python programming is fun"), (3, "Rust and Python programming"), (4, "Cooking recipes"), (5, None), (6, "the quick brown fox"), (7, "brown quick fox")]
    return spark.createDataFrame(rows, "id long, content string")


def hits(rows):
    return [r.id for r in rows.orderBy(F.desc("_score"), "id").collect()]


def test_text_search(articles):
    assert sorted(hits(search.text_search(articles, ir.TextMatch("content", "programming")))) == [1, 2, 3]
    assert sorted(hits(search.text_search(articles, ir.TextMatch("content", "Rust")))) == [1, 3]
    assert hits(search.text_search(articles, ir.TextPhrase("content", "quick brown fox"))) == [6]
    assert sorted(hits(search.text_search(articles, ir.TextBoolean("content", ("programming",), (), ("Python",))))) == [1]
    assert hits(search.text_search(articles, ir.TextBoolean("content", ("Rust", "programming", "python")))) == [3]
    assert hits(search.text_search(articles, ir.TextBoolean("content", (), (), ("Python",)))) == []
    assert hits(search.text_search(articles, ir.TextMatch("content", "the"))) == []  # a stop word
    assert hits(search.text_search(articles.limit(0), ir.TextMatch("content", "rust"))) == []


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<float>")
    near = search.nearest_vectors(rows, ir.VectorNear("v", (1.0, 0.0), 5, 0.1), ("id",)).collect()
    assert [r.id for r in near] == [1]
    assert [round(r._distance, 6) for r in search.nearest_vectors(rows, ir.VectorNear("v", (0.0, 4.0), 2, metric="euclidean"), ("id",)).collect()] == [3.0, 4.0]
    assert rows.where("id = 3").select(vector.distance(F.col("v"), (1.0, 0.0))).first()[0] == 1.0
    with pytest.raises(ValueError):
        search.nearest_vectors(rows, ir.VectorNear("v", (1.0, 0.0), 1), ("id",), 3)


def test_geo(spark):
    points = spark.createDataFrame([(1, (37.77, -122.42)), (2, (37.78, -122.41)), (3, (37.76, -122.43)), (4, (37.87, -122.27)), (5, None)], "id int, p struct<lat: double, lon: double>")
    p = F.col("p")
    found = lambda c: [r.id for r in points.where(c).orderBy("id").collect()]
    assert found(geo.within_radius(p, 37.77, -122.42, 5.0)) == [1, 2, 3]
    assert found(geo.within_box(p, 37.765, -122.425, 37.79, -122.40)) == [1, 2]
    assert found(geo.within_polygon(p, ((37.75, -122.45), (37.80, -122.40), (37.75, -122.35)))) == [1, 2, 3]
    assert found(geo.within_polygon(p, ((0.0, 0.0), (1.0, 1.0)))) == []


def test_capabilities():
    context = security.Context.of("ann", "read:Post*", "delete:User", "sensitive:sensitive", "custom:audit")
    assert context.may("read", "PostTag") and not context.may("read", "User") and context.may("delete", "User") and not context.may("write", "Post")
    assert context.sees("internal") and not context.sees("restricted") and context.custom("audit")
    assert security.Context.of(None, "admin").may("write", "X")
    for bad in ("fly", "custom", "sensitive:odd"):
        with pytest.raises(ValueError):
            security.Capability.parse(bad)


def test_policies_fail_closed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, team string")
    policy = lambda rule, permissive=True: security.Policy("T", rule, permissive)
    see = lambda policies, **attributes: [r.id for r in rows.where(security.row_condition(policies, "T", security.Context.of("x", **attributes), rows.schema)).collect()]
    own = security.AttributeEq("team", "team")
    assert see((policy(own),), team="a") == [1] and see((policy(own),), team=["a", "b"]) == [1, 2] and see((policy(own),)) == []
    assert see((policy(ir.Not(own)),)) == []
    assert see((policy(ir.And()), policy(ir.And((own, ir.gt("id", 0))), False)), team="b") == [2]
    assert security.row_condition((policy(own),), "T", security.Context.of("x", "admin"), rows.schema) is None


def test_masks(spark):
    rows = spark.createDataFrame([("abcdef", 7), ("ab", None), (None, 1)], "s string, i int")
    shown = lambda c, kind, *how: [r[0] for r in rows.select(security.mask(F.col(c), rows.schema[kind].dataType, how)).collect()]
    assert shown("s", "s", "partial", 2, True, "*") == ["****ef", "**", None]
    assert shown("s", "s", "partial", 2, False, "#") == ["ab####", "##", None]
    assert shown("i", "i", "partial", 2, True, "*") == [None, None, None]
    assert shown("s", "s", "redacted", "x") == ["x"] * 3 and shown("i", "i", "null") == [None] * 3
    assert shown("i", "i", "hash")[0].startswith("hash:") and security.mask(F.col("s"), None, ("omit",)) is None
    assert security.audit_events(spark, [("ann", "query", "T", "")]).count() == 1


HISTORY = [(1, "a", 1, False), (1, "b", 3, False), (2, "c", 1, False), (2, None, 2, True), (3, None, 4, False)]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(HISTORY, "id int, v string, version_ts int, deleted boolean")


def test_history(spark, history):
    view = lambda rows: sorted((r.id, r.v) for r in rows.collect())
    assert view(store.latest_view(history, ("id",))) == [(1, "b"), (3, None)]
    assert view(store.as_of(history, ("id",), 1)) == [(1, "a"), (2, "c")]
    assert view(store.as_of(history, ("id",), 2)) == [(1, "a")]  # deleted rows don't come back
    assert view(store.get(history, ("id",), [(2,), (3,)])) == [(3, None)]
    kept = {(r.id, r.version_ts) for r in store.compacted(history, ("id",), 1, 99, 3).collect()}
    assert kept == {(1, 3), (3, 4)}


def test_transaction(spark, history):
    work = store.Transaction(history, ("id",))
    at = F.lit(9)
    work.insert(spark.createDataFrame([(5, "new")], "id int, v string"), at)
    work.update(spark.createDataFrame([(5, "newer"), (77, "none")], "id int, v string"), F.lit(10))
    work.delete(spark.createDataFrame([(1,)], "id int"), at)
    assert sorted((r.id, r.v) for r in work.view().collect()) == [(3, None), (5, "newer")]
    work.expect((1,), 3)
    assert work.commit().count() == 3
    with pytest.raises(RuntimeError):
        work.delete(spark.createDataFrame([(1,)], "id int"), at)
    other = store.Transaction(history, ("id",))
    other.expect((1,), 2)
    with pytest.raises(store.Conflict):
        other.commit()
    other.rollback()


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 50), (4, None, 1)], "id int, k string, n int")
    assert {r.k: r["rows"] for r in constraints.unique_violations(rows, ("k",)).collect()} == {"a": 2, None: 2}
    holds = lambda text: [r.id for r in rows.where(constraints.check_column(text, rows.schema)).orderBy("id").collect()]
    assert holds("n >= 5 AND k IS NOT NULL") == [1]
    assert holds("NOT (n > 5) OR k = 'zz'") == [1, 2, 4]
    assert holds("n <> 5") == [3, 4] and holds("n IN (1, 50)") == [3, 4] and holds("n = NULL") == [] and holds("") == [1, 2, 3, 4]
    assert [r.id for r in constraints.check_violations(rows, "n < 10").orderBy("id").collect()] == [2, 3]
    for bad in ("n >", "(n = 1", "n ~ 1", "n = 1 k", "5 = n"):
        with pytest.raises(ValueError):
            constraints.parse_check(bad)


def test_cascade_ends_in_cycles(spark):
    node = Entity("Node", ("id",), (Field("id", scalar("int32")), Field("up", optional("int32"))))
    schema = Schema.of([node], [Relation("children", "Node", ("id",), "Node", ("up",), on_delete="cascade")])
    rows = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id int, up int")
    doomed = constraints.cascade(schema, {"Node": rows}, "Node", rows.where("id = 1"))
    assert sorted(r.id for r in doomed["Node"].collect()) == [1, 2, 3]
    with pytest.raises(constraints.Restricted):
        constraints.restrict(rows.where("id = 4"), schema.relation("Node", "children"), rows)


def test_subscription_resumes(spark, tmp_path):
    log = spark.createDataFrame([(k, "a" if k % 2 else "b", k, "update", float(k)) for k in range(1, 7)], "lsn long, entity string, id long, op string, value double")
    path, out, check = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")
    log.where("lsn <= 3").write.mode("append").parquet(path)
    stream = lambda: changes.subscription(spark, path, log.schema, "a", ir.gt("value", 0.5), ("lsn",))
    changes.deliver(stream(), check, out).awaitTermination()
    log.where("lsn > 3").write.mode("append").parquet(path)
    changes.deliver(stream(), check, out).awaitTermination()
    assert sorted(r.lsn for r in spark.read.parquet(out).collect()) == [1, 3, 5]
    seen = []
    changes.deliver(stream(), str(tmp_path / "other"), lambda rows, n: seen.extend(r.lsn for r in rows.collect())).awaitTermination()
    assert sorted(seen) == [1, 3, 5]


def test_changes_and_restore(spark, tmp_path):
    log = spark.createDataFrame([(1, "T", 1, "insert", "a"), (2, "T", 2, "insert", "b"), (3, "T", 1, "update", "c"), (4, "T", 2, "delete", None)], "lsn long, entity string, id long, op string, v string")
    part = changes.batch(log, 2, 2)
    assert [r.lsn for r in part.rows.collect()] == [2, 3] and part.has_more() and part.next_lsn().first()[0] == 4
    assert changes.batch(log, 9, 2).next_lsn().first()[0] == 9
    assert [(r.id, r.v) for r in changes.applied(log).collect()] == [(1, "c")]
    more = changes.appended(log, spark.createDataFrame([("T", 9, "insert", "z")], "entity string, id long, op string, v string"), ["id"])
    assert more.first().lsn == 5
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sinks.backup({"T": snapshot}, str(tmp_path), 2)
    sinks.backup_changes(log, str(tmp_path), 2)
    again = sinks.restore(spark, str(tmp_path), "T", 2)
    assert sorted(map(tuple, sinks.restore_until(again, log, "T", "id", 2, 3).collect())) == [(1, "c"), (2, "b")]
    assert sorted(map(tuple, sinks.restore_until(again, log, "T", "id", 2, 4).collect())) == [(1, "c")]


def _entity(*fields, **more):
    return Schema.of([Entity("E", ("id",), (Field("id", scalar("int64")), *fields), **more)])


@pytest.mark.parametrize(
    "old, new, grade",
    [
        (_entity(), _entity(Field("x", optional("string"))), "A"),
        (_entity(), _entity(Field("x", scalar("string"), True, "'a'")), "B"),
        (_entity(), _entity(Field("x", scalar("string"), True)), "D"),
        (_entity(Field("x", scalar("string"))), _entity(), "D"),
        (_entity(Field("x", scalar("int32"))), _entity(Field("x", scalar("int64"))), "B"),
        (_entity(Field("x", scalar("int64"))), _entity(Field("x", scalar("int32"))), "C"),
        (_entity(Field("x", optional("int32"))), _entity(Field("x", scalar("int32"))), "C"),
        (_entity(Field("x", scalar("int32"))), _entity(Field("x", optional("int32"))), "A"),
        (_entity(Field("x", scalar("string"))), _entity(Field("x", scalar("int32"))), "D"),
        (_entity(Field("x", enum("K", "a"))), _entity(Field("x", enum("K", "a", "b"))), "A"),
        (_entity(Field("x", enum("K", "a", "b"))), _entity(Field("x", enum("K", "a"))), "D"),
        (_entity(Field("x", scalar("int32"))), _entity(Field("x", scalar("int32"), indexed=True)), "B"),
        (_entity(soft_delete=True), _entity(), "C"),
        (_entity(), Schema(), "D"),
        (Schema(), _entity(), "A"),
    ],
)
def test_grades(old, new, grade):
    assert migration.overall(migration.diff(old, new), new) == grade


def test_plan_order_and_resume():
    old, new = _entity(Field("x", scalar("int32")), Field("gone", scalar("string"))), _entity(Field("x", scalar("int64")), Field("y", scalar("string"), True, "'a'"))
    steps = migration.plan(migration.diff(old, new), new)
    order = [migration.PHASES.index(s.phase) for s in steps]
    assert order == sorted(order) and {s.action for s in steps} >= {"add_field", "default", "cast", "not_null", "drop_field"}
    run, seen = migration.Run(steps), []

    def perform(step):
        if len(seen) == 2 and "failed" not in seen:
            seen.append("failed")
            raise RuntimeError
        seen.append(step)

    with pytest.raises(RuntimeError):
        run.resume(perform)
    assert run.status == "running"
    run.resume(perform)
    assert run.status == "done" and [s for s in seen if s != "failed"] == steps
    run.rollback(lambda s: None)
    assert run.status == "pending"
