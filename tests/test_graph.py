"""Graph queries over a small blog."""

import pytest

from entigraph.operators import security
from entigraph.operators.graph import Engine, nested
from entigraph.plans import explain, ir, language
from entigraph.plans.model import Catalog, Constraint, Entity, Field, Relation, Schema, enum, optional, scalar
from entigraph.plans.planner import plan
from entigraph.sources import sinks

USER = Entity("User", ("id",), (Field("id", scalar("int64")), Field("name", scalar("string")), Field("email", optional("string")), Field("age", optional("int32"))))
POST = Entity("Post", ("id",), (Field("id", scalar("int64")), Field("title", scalar("string")), Field("author_id", optional("int64")), Field("views", scalar("int64"))))
COMMENT = Entity("Comment", ("id",), (Field("id", scalar("int64")), Field("text", scalar("string")), Field("post_id", optional("int64"))))
SCHEMA = Schema.of(
    [USER, POST, COMMENT],
    [Relation("posts", "User", ("id",), "Post", ("author_id",)), Relation("comments", "Post", ("id",), "Comment", ("post_id",)), Relation("author", "Post", ("author_id",), "User", ("id",), "many_to_one")],
    [Constraint("email", "unique", "User", ("email",)), Constraint("adult", "check", "User", expression="age >= 18"), Constraint("fk", "foreign_key", "Post", ("author_id",), "User", ("id",))],
)


@pytest.fixture(scope="module")
def blog(spark):
    users = [(1, "Alice", "alice@example.com", 30), (2, "Bob", "bob@test.com", 25), (3, "Charlie", "charlie@example.com", 35), (4, "Dora", None, None)]
    posts = [(10, "Popular Post", 1, 1000), (11, "Quiet Post", 1, 10), (12, "Third", 3, 500), (13, "Stray", None, 7), (14, "Tied", 1, 10)]
    comments = [(100, "a", 10), (101, "b", 10), (102, "c", 12), (103, "d", None)]
    make = spark.createDataFrame
    return Engine(SCHEMA, {"User": make(users, USER.struct()), "Post": make(posts, POST.struct()), "Comment": make(comments, COMMENT.struct())})


def ids(rows, name="id"):
    return [r[name] for r in rows.collect()]


def test_and_filter(blog):
    found = blog.query("User").gt("age", 25).like("email", "%example.com").order_by("age").execute()
    assert ids(found.root) == [1, 3]


def test_order_nulls_and_ties(blog):
    assert ids(blog.query("User").order_by("age").execute().root) == [4, 2, 1, 3]
    assert ids(blog.query("User").order_by_desc("age").execute().root) == [3, 1, 2, 4]
    assert ids(blog.query("Post").order_by("views").execute().root) == [13, 11, 14, 12, 10]


def test_pages(blog):
    first = blog.query("User").limit(2).execute()
    assert ids(first.root) == [1, 2] and first.has_more()
    last = blog.query("User").limit(2).offset(2).execute()
    assert ids(last.root) == [3, 4] and not last.has_more()
    assert ids(blog.query("User").offset(9).execute().root) == []
    assert ids(blog.query("User").offset(3).execute().root) == [4]


def test_include_filter_keeps_parents(blog):
    found = blog.query("User").include_filtered("posts", ir.gt("views", 500)).execute()
    assert sorted(ids(found.root)) == [1, 2, 3, 4]
    assert [r.title for r in found.blocks["posts"].collect()] == ["Popular Post"]
    assert [tuple(r) for r in found.edges["posts"].collect()] == [(1, 10)]


def test_nested_paths_and_missing_parents(blog):
    found = blog.query("User").include("posts.comments").execute()
    assert sorted(ids(found.blocks["posts.comments"])) == [100, 101, 102]
    assert sorted(map(tuple, found.edges["posts.comments"].collect())) == [(10, 100), (10, 101), (12, 102)]


def test_per_parent_limit(blog):
    found = blog.query("User").include("posts", order=(ir.Order("views", True),), limit=1, offset=1).execute()
    assert ids(found.blocks["posts"]) == [11]


def test_many_to_one_block_is_distinct(blog):
    found = blog.query("Post").include("author").execute()
    assert sorted(ids(found.blocks["author"])) == [1, 3]
    assert sorted(map(tuple, found.edges["author"].collect())) == [(10, 1), (11, 1), (12, 3), (14, 1)]


def test_nested_agrees_with_blocks(blog):
    found = blog.query("User").select("name").include("posts", fields=("title",)).execute()
    rows = {r.id: [p.id for p in r.posts] for r in nested(found, SCHEMA, "posts").collect()}
    assert rows == {1: [10, 11, 14], 2: [], 3: [12], 4: []}


def test_projection_and_errors(blog):
    assert blog.query("User").select("name").execute().root.columns == ["id", "name"]
    for bad in (ir.GraphQuery("Nobody"), ir.GraphQuery("User", ("zz",)), ir.GraphQuery("User", where=ir.eq("zz", 1)), ir.GraphQuery("User", includes=(ir.Include("zz"),)), ir.GraphQuery("User", limit=-1)):
        with pytest.raises(ValueError):
            blog.execute(bad)
    with pytest.raises(ValueError, match="deeper"):
        plan(SCHEMA, ir.GraphQuery("User", includes=(ir.Include("posts.comments"),)), 1)


def test_budgets(blog):
    context = security.Context("ann", frozenset({security.Capability("admin")}), {}, security.Budget(5, 3, 10), True)
    with pytest.raises(security.BudgetExceeded, match="entities"):
        blog.execute(ir.GraphQuery("User"), context)
    context = security.Context("ann", frozenset({security.Capability("admin")}), {}, security.Budget(5, 10, 3), True)
    with pytest.raises(security.BudgetExceeded, match="edges"):
        blog.execute(ir.GraphQuery("User", includes=(ir.Include("posts"),)), context)


def test_language(blog):
    run = lambda source: language.run(blog, source)
    assert ids(run('User.findMany().where(name == "Bob" || age >= 35).orderBy(age.desc)').root) == [3, 2]
    assert ids(run("User.findFirst().where(email is not null)").root) == [1]
    assert run("User.count().where(age not in [25, 30])").first()[0] == 2
    with pytest.raises(ValueError, match="more than one"):
        run("User.findUnique().where(age > 1)")
    assert "User.posts" in run(".describe posts") and "User(" in run(".schema User") and "findMany" in run(".help")
    made = language.parse('User.update().where(id == 1).set({name: "X", age: 3})')
    assert made.data == (("name", "X"), ("age", 3)) and made.query.where == ir.eq("id", 1)
    assert language.parse("User.create({name: 'a\\'b', age: -2, x: 1.5, y: null})").data == (("name", "a'b"), ("age", -2), ("x", 1.5), ("y", None))


@pytest.mark.parametrize("source", ["User.findMany(", "User.find()", "User.findMany().where(a = 1)", "User.findMany().limit(x)", "User.findUnique()", ".nope", "User.findMany() x", "User.findMany().where(a like 3)"])
def test_language_errors(source):
    with pytest.raises(language.LanguageError, match=r"\^"):
        language.parse(source)


def test_explain_metrics_sinks(blog, tmp_path):
    query = ir.GraphQuery("User", where=ir.gt("age", 20), includes=(ir.Include("posts"),))
    assert "include posts" in explain.summary(blog, query)
    assert "Physical Plan" in explain.physical(blog.execute(query).root)
    metrics = explain.Metrics()
    with metrics.timed("graph"):
        found = blog.execute(query)
    assert metrics.counts["graph", "ok"] == 1 and "entigraph_queries_total" in metrics.text() and metrics.quantile("graph", 0.5) >= 0
    assert "Alice" in sinks.table_text(found.root)
    assert '"name":"Alice"' in sinks.json_rows(found.root.orderBy("id")).first().json
    for kind in ("json", "csv", "parquet"):
        sinks.write_result(found, str(tmp_path / kind), kind)
    assert (tmp_path / "csv/edges/posts").exists()


def test_catalog_round_trip():
    catalog = Catalog()
    one = catalog.apply(SCHEMA)
    two = catalog.apply(Schema.of([*SCHEMA.entities.values(), Entity("Tag", ("id",), (Field("id", scalar("int64")), Field("kind", enum("Kind", "a", "b"))))], list(SCHEMA.relations.values())))
    assert (one.version, two.version) == (1, 2) and catalog.current() == two and catalog.at(1) == one
    assert Catalog.of_rows(catalog.rows()).versions == catalog.versions
    with pytest.raises(ValueError):
        Relation("x", "A", ("a",), "B", ("b",), "many_to_many")
