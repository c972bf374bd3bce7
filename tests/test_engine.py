import pytest
from pyspark.sql import functions as F

from quernel.functions import scalars
from quernel.operators import access, constraints, mutate
from quernel.plans.engine import Engine
from quernel.plans.model import Config, Conflict, Forbidden, ForeignKey, ForeignKeyViolation, LimitExceeded, ListRequest, NotFound, NotNull, NotNullViolation, OnDelete, QuernelError, Schema, SchemaViolation, Unique, UniqueViolation
from quernel.sources import backends, export, stores
from quernel.streaming import routing, streams


@pytest.fixture
def blog(spark):
    users = spark.createDataFrame([("u1", "Ann", "a@x"), ("u2", "Ben", "b@x")], "id string, name string, email string")
    posts = spark.createDataFrame([("p1", "One", "u1"), ("p2", "Two", "u1"), ("p3", "Three", "u2"), ("p4", "None", None)], "id string, title string, author_id string")
    comments = spark.createDataFrame([("c1", "hi", "p1"), ("c2", "ho", "p3")], "id string, text string, post_id string")
    return Engine(spark).add_entity("users", users).add_entity("posts", posts).add_entity("comments", comments)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_cascade_and_restrict(spark, blog):
    blog.add_constraint(ForeignKey("posts", "author_id", "users", on_delete=OnDelete.CASCADE)).add_constraint(ForeignKey("comments", "post_id", "posts", on_delete=OnDelete.CASCADE))
    gone = blog.delete("users", blog.read("users", "u1"))
    assert {e: ids(df) for e, df in gone.items()} == {"users": ["u1"], "posts": ["p1", "p2"], "comments": ["c1"]}
    assert ids(blog.list(ListRequest("posts"))) == ["p3", "p4"] and ids(blog.list(ListRequest("comments"))) == ["c2"]
    assert sum(e.count() for e in blog.events) == 4
    blog.rules = [ForeignKey("posts", "author_id", "users")]
    with pytest.raises(ForeignKeyViolation):
        blog.delete("users", blog.read("users", "u2"))
    assert ids(blog.list(ListRequest("users"))) == ["u2"]


def test_set_null_and_not_null(spark, blog):
    rule = ForeignKey("posts", "author_id", "users", on_delete=OnDelete.SET_NULL)
    blog.add_constraint(rule)
    blog.delete("users", blog.read("users", "u1"))
    assert {r["id"]: r["author_id"] for r in blog.list(ListRequest("posts")).collect()} == {"p1": None, "p2": None, "p3": "u2", "p4": None}
    with pytest.raises(SchemaViolation):
        constraints.check_set_null(rule, None, [NotNull("posts", "author_id")])


def test_owner_aware_cascade(spark):
    projects = spark.createDataFrame([("a", "me")], "id string, userId string")
    tasks = spark.createDataFrame([("t1", "me", "a"), ("t2", "you", "a"), ("t3", "me", None)], "id string, userId string, projectId string")
    e = Engine(spark, owners={"projects": "userId", "tasks": "userId"}).add_entity("projects", projects).add_entity("tasks", tasks)
    e.add_constraint(ForeignKey("tasks", "projectId", "projects", on_delete=OnDelete.CASCADE))
    tables, rules = e.tables, e.rules
    with pytest.raises(ForeignKeyViolation):
        constraints.cascade(tables, rules, "projects", projects, (e.owners, "me"), [NotNull("tasks", "projectId")])
    e.delete("projects", projects, sender="me")
    assert {r["id"]: r["projectId"] for r in e.list(ListRequest("tasks")).collect()} == {"t2": None, "t3": None}


def test_cyclic_references_end(spark):
    rows = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", None)], "id string, parent string")
    rule = ForeignKey("nodes", "parent", "nodes", on_delete=OnDelete.CASCADE)
    gone = constraints.cascade({"nodes": (rows, "id")}, [rule], "nodes", rows.filter("id = 'a'"))
    assert ids(gone["nodes"]) == ["a", "b", "c"]
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 30)], "id string, parent string")
    with pytest.raises(LimitExceeded):
        constraints.cascade({"nodes": (chain, "id")}, [rule], "nodes", chain.filter("id = '1'"))


def test_writes_are_checked(spark, blog):
    blog.add_schema(Schema("users", {"name": scalars.field("string", True), "email": scalars.field("string"), "active": scalars.field("boolean", default=True)})).add_constraint(Unique("users", ("email",)))
    row = lambda *r: spark.createDataFrame([r], "id string, name string, email string")
    assert blog.create("users", row("u3", "Cid", "c@x")).filter("id = 'u3'").first().active is True
    for bad, error in ((("u4", None, "d@x"), SchemaViolation), (("u5", "Eve", "a@x"), UniqueViolation)):
        with pytest.raises(error):
            blog.create("users", row(*bad))
    with pytest.raises(Conflict):
        blog.create("users", row("u1", "Ann", "z@x"), strict=True)
    blog.add_constraint(NotNull("users", "email"))
    with pytest.raises(NotNullViolation):
        blog.create("users", row("u6", "Fay", None))
    blog.add_constraint(ForeignKey("posts", "author_id", "users"))
    with pytest.raises(ForeignKeyViolation):
        blog.create("posts", spark.createDataFrame([("p9", "x", "nobody")], "id string, title string, author_id string"))
    with pytest.raises(UniqueViolation):
        blog.add_constraint(Unique("posts", ("author_id",)))
    changed = blog.update("users", spark.createDataFrame([("u2", "Bea"), ("zz", "no")], "id string, name string"))
    assert {r.id: r.name for r in changed.collect()}["u2"] == "Bea" and changed.count() == 3
    assert blog.schemas["users"].revised({}).version == 2


def test_requests(spark, blog):
    blog.add_relationship("posts", "author", "users").add_relationship("comments", "post", "posts").add_index("posts", "title")
    rows = blog.execute({"op": "list", "entity": "comments", "includes": ["post.author"], "sort": [{"field": "id"}]}).collect()
    assert [(r.id, r.post.title, r.post__author.name) for r in rows] == [("c1", "One", "Ann"), ("c2", "Three", "Ben")]
    assert blog.execute({"op": "read", "entity": "posts", "id": "p4", "includes": ["author"]}).first().author is None
    assert blog.execute({"op": "count", "entity": "posts", "filters": [{"field": "author_id", "op": "null", "value": None}]}).first().n == 1
    assert [r.id for r in blog.cursor(ListRequest("posts").where("author_id", "lte", None))] == ["p4"]
    assert blog.entity_names() == ["comments", "posts", "users"] and blog.entity_record_count("posts") == 4
    assert {r.entity: r.record_count for r in blog.catalog().collect()} == {"comments": 2, "posts": 4, "users": 2}
    for request, error in (({"op": "list", "entity": "nope"}, NotFound), ({"op": "list", "entity": "_shares"}, Forbidden), ({"op": "dance", "entity": "posts"}, QuernelError)):
        with pytest.raises(error):
            blog.execute(request)
    with pytest.raises(QuernelError):
        blog.list(ListRequest("posts").include("nothing"))
    with pytest.raises(LimitExceeded):
        blog.list(ListRequest("posts").include("a.b.c.d"))


def test_backup_and_restore(spark, blog, tmp_path):
    before = {e: sorted(map(tuple, df.collect())) for e, (df, _) in blog.tables.items()}
    blog.backup(f"{tmp_path}/b")
    assert {e: sorted(map(tuple, df.collect())) for e, (df, _) in blog.restore(f"{tmp_path}/b").tables.items()} == before


def test_update_tells_null_from_absent(spark):
    state = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1)], "id string, n int, s string, _version bigint")
    delta = spark.createDataFrame([("a", None, None, True, False)], "id string, n int, s string, has_n boolean, has_s boolean")
    out = mutate.update(state, delta, given=lambda new, c: new[f"has_{c}"] if c in ("n", "s") else F.lit(False))
    assert {r.id: (r.n, r.s, r._version) for r in out.collect()} == {"a": (None, "x", 2), "b": (2, "y", 1)}


def test_closure_limit(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)], "parent bigint, child bigint")
    with pytest.raises(LimitExceeded):
        access.closure(edges, spark.range(1))
    assert access.closure(edges.limit(0), spark.range(1)).count() == 1


def test_groups(spark):
    member = lambda *m: spark.createDataFrame([("g", x) for x in m], "share_group string, member string")
    of = lambda df: {r.partition: r.member for r in routing.assignments(df).collect()}
    assert of(member("a")) == {p: "a" for p in range(8)}
    two = of(member("b", "a"))
    assert [two[p] for p in range(8)] == ["a", "b"] * 4
    subs = spark.createDataFrame([("1", "a/#", None, "g", "ordered")], "subscription_id string, pattern string, entity string, share_group string, mode string")
    with pytest.raises(QuernelError):
        routing.subscribe(subs, spark.createDataFrame([("2", "a/#", None, "g", "broadcast")], subs.schema))


def test_outbox_stream_retries_and_dead_letters(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in/events.parquet")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in/events.parquet")
    tries = []

    def deliver(batch, batch_id):
        tries.append(batch.count())
        raise OSError("down")

    streams.to_outbox(stream, deliver, f"{tmp_path}/dead", f"{tmp_path}/cp", retries=3)
    assert tries == [10, 10, 10] and spark.read.parquet(f"{tmp_path}/dead").count() == 10


def test_document_source_and_exports(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.jsonl").write_text("".join(f'{{"id": "{i}{k}", "data": "d{k}"}}\n' for k in range(3)))
    spark.dataSource.register(stores.DocumentSource)
    df = spark.read.format("quernel").option("path", str(tmp_path)).load()
    assert df.count() == 6 and [r.id for r in df.filter("data = 'd1'").orderBy("id").collect()] == ["01", "11"]
    rows = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "n int, s string")
    assert [r.value for r in export.csv_lines(rows).collect()] == ['1,"a,""b"""', "2,"]
    assert export.text_table(rows).splitlines()[0] == "n  s" and export.json_lines(rows).count() == 2
    page = stores.query(df, "id=01", 5).collect()
    assert [(r.id, r.has_more) for r in page] == [("01", False)]


def test_vault_binds_to_the_record(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    df = spark.createDataFrame([("1", "secret", 5, True, "me"), ("2", None, None, None, "me")], "id string, s string, n int, b boolean, owner string")
    sealed = scalars.seal_fields(df, key, "e", "owner")
    assert sealed.filter("s like '%secret%'").count() == 0 and [r.owner for r in sealed.collect()] == ["me", "me"]
    assert sorted(map(tuple, scalars.unseal_fields(sealed, df.schema, key, "e", "owner").collect())) == sorted(map(tuple, df.collect()))
    moved = sealed.withColumn("id", F.lit("9"))
    with pytest.raises(Exception, match="AES|decrypt|tag|CRYPTO"):
        scalars.unseal_fields(moved, df.schema, key, "e", "owner").collect()


def test_shares_and_subscriptions(spark, blog):
    blog.owners = {"posts": "author_id"}
    assert blog.share("posts", "p3", "u1", "view", "u2") == 1
    blog.execute({"op": "share", "entity": "posts", "id": "p3", "grantee": "u1", "permission": "edit", "by": "u2"})
    assert ids(blog.accessible("posts", "u1", "edit")) == ["p1", "p2", "p3"] and [r.level for r in blog.shared("posts", "u1").collect()] == [2]
    blog.derived = {"comments": ("post_id", "posts")}
    assert ids(blog.accessible("comments", "u1")) == ["c1", "c2"]
    assert blog.execute({"op": "shares", "entity": "posts", "id": "p3"}).count() == 1
    blog.execute({"op": "unshare", "entity": "posts", "id": "p3", "grantee": "u1"})
    assert ids(blog.accessible("comments", "u1")) == ["c1"] and ids(blog.list(ListRequest("posts"), sender="u2")) == ["p3"]
    blog.subscribe("s1", "posts/#").subscribe("s2", "users/+", share_group="g", mode="ordered").subscribe("s3", "users/+", share_group="g", mode="ordered")
    blog.delete("posts", blog.read("posts", "p1"))
    blog.create("users", spark.createDataFrame([("u9", "Zed", "z@x")], "id string, name string, email string"))
    assert sorted((r.id, r.operation, r.subscription_id) for r in blog.deliveries().collect()) == [("p1", "Delete", "s1"), ("u9", "Create", "s2"), ("u9", "Create", "s3")]
    blog.heartbeat("s2", 100)
    assert {r.member for r in blog.groups(110).collect()} == {"s2"}
    blog.execute({"op": "unsubscribe", "subscription_id": "s2"})
    for wrong in (lambda: blog.unsubscribe("s2"), lambda: blog.heartbeat("s2", 1), lambda: blog.subscribe("s4", "a/#/b"), lambda: blog.subscribe("s5", "a", share_group="g", mode="broadcast"), lambda: blog.share("posts", "p1", "u1", "own", "u1")):
        with pytest.raises(QuernelError):
            wrong()


def test_paged_cursor(spark):
    rows = spark.range(50).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), (F.col("id") % 2 == 0).alias("active"), F.col("id").alias("age"))
    pages = Engine(spark).add_entity("users", rows).pages(ListRequest("users", batch_size=7).where("active", "eq", True))
    got = [len(pages.next_batch(10)) for _ in range(4)]
    assert got == [10, 10, 5, 0] and pages.position == 25 and not pages.has_more() and pages.next() is None
    pages.reset()
    assert pages.has_more() and pages.next()["id"] == "000" and pages.next()["id"] == "002" and pages.count() == 25
    with pytest.raises(QuernelError):
        Engine(spark).add_entity("users", rows).pages(ListRequest("users").order("age"))


def test_commit_is_all_or_nothing(spark, blog):
    blog.add_constraint(Unique("users", ("email",))).add_constraint(ForeignKey("posts", "author_id", "users"))
    user = lambda *r: spark.createDataFrame([r], "id string, name string, email string")
    post = lambda *r: spark.createDataFrame([r], "id string, title string, author_id string")
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    blog.commit({"users": {"puts": user("u3", "Cid", "c@x"), "absent": key("u3")}, "posts": {"puts": post("p1", "One!", "u3"), "removes": key("p4"), "equal": blog.read("posts", "p1").select("id", "title")}})
    assert ids(blog.list(ListRequest("users"))) == ["u1", "u2", "u3"] and ids(blog.list(ListRequest("posts"))) == ["p1", "p2", "p3"]
    assert sorted((r.entity, r.id, r.operation) for e in blog.events for r in e.collect()) == [("posts", "p1", "Update"), ("posts", "p4", "Delete"), ("users", "u3", "Create")]
    before = {n: sorted(map(tuple, df.collect())) for n, (df, _) in blog.tables.items()}
    wrong = (
        ({"users": {"puts": user("u4", "D", "d@x"), "absent": key("u1")}}, Conflict),
        ({"users": {"puts": user("u4", "D", "d@x")}, "posts": {"removes": key("p1"), "equal": post("p1", "One", "u3")}}, Conflict),
        ({"posts": {"removes": key("p1"), "equal": post("zz", "none", None)}}, Conflict),
        ({"users": {"puts": user("u4", "D", "a@x")}, "posts": {"removes": key("p1")}}, UniqueViolation),
        ({"posts": {"removes": key("p1")}, "users": {"removes": key("u2")}}, ForeignKeyViolation),
    )
    for batch, error in wrong:
        with pytest.raises(error):
            blog.commit(batch)
    assert {n: sorted(map(tuple, df.collect())) for n, (df, _) in blog.tables.items()} == before and len(blog.events) == 2
    blog.keep()
    assert "Join" not in blog.tables["posts"][0]._jdf.queryExecution().toString()


def test_senders_are_held_to_ownership_and_shares(spark, blog):
    blog.owners, blog.derived, blog.admins = {"posts": "author_id"}, {"comments": ("post_id", "posts")}, frozenset({"root"})
    ask = lambda op, entity, sender, **more: blog.execute({"op": op, "entity": entity, "sender": sender, **more})
    for request in (("read", "posts", "u2", {"id": "p1"}), ("update", "posts", "u2", {"rows": [("p1", "x", None)]}), ("delete", "posts", "u2", {"id": "p1"}), ("share", "posts", "u2", {"id": "p1", "grantee": "u2", "permission": "edit", "by": "u2"}), ("read", "comments", "u2", {"id": "c1"}), ("create", "comments", "u2", {"rows": [("c9", "x", "p1")]}), ("backup", "", "u2", {"path": "x"})):
        with pytest.raises(Forbidden):
            ask(request[0], request[1], request[2], **request[3])
    for request in (("read", "posts", "u1", {"id": "nope"}), ("update", "posts", None, {"rows": [("nope", "x", None)]}), ("delete", "posts", "u1", {"id": "nope"})):
        with pytest.raises(NotFound):
            ask(request[0], request[1], request[2], **request[3])
    assert ask("count", "posts", "u1").first().n == 2 and ask("count", "posts", "root").first().n == 4 and ids(ask("list", "comments", "u2")) == ["c2"]
    assert [r.id for r in blog.cursor(ListRequest("posts"), "u2")] == ["p3"] and len(blog.pages(ListRequest("posts"), "u1").next_batch(9)) == 2
    ask("share", "posts", "u1", id="p1", grantee="u2", permission="view", by="u1")
    assert ask("read", "posts", "u2", id="p1").first().title == "One" and ids(ask("list", "comments", "u2")) == ["c1", "c2"]
    with pytest.raises(Forbidden):
        ask("update", "posts", "u2", rows=[("p1", "mine", None)])
    ask("share", "posts", "u1", id="p1", grantee="u2", permission="edit", by="u1")
    assert {r.id: r.title for r in ask("update", "posts", "u2", rows=[("p1", "ours", None)]).collect()}["p1"] == "ours"
    ask("create", "comments", "u2", rows=[("c9", "x", "p1")])
    with pytest.raises(Forbidden):  # an editor does not delete
        ask("delete", "posts", "u2", id="p1")
    assert {r.id: r.author_id for r in ask("create", "posts", "u2", rows=[("p9", "new", "u1")]).collect()}["p9"] == "u2"  # owners are senders
    ask("delete", "posts", "u1", id="p1")
    with pytest.raises(NotFound):
        ask("read", "posts", "root", id="p1")


def test_catalog_and_registry(spark, blog):
    blog.add_constraint(NotNull("users", "name"))
    blog.owners, blog.scopes = {"posts": "author_id"}, {"posts": "author"}
    blog.execute({"op": "schema_set", "entity": "users", "schema": Schema("users", {"name": scalars.field("string", True)})})
    assert blog.execute({"op": "index_add", "entity": "users", "fields": ["name"]}) == ["name"]
    rows = {r.entity: r for r in blog.execute({"op": "catalog"}).collect()}
    assert rows["users"].record_count == 2 and '"required": true' in rows["users"].schema and rows["users"].indexes == ["name"] and "NotNull" in rows["users"].constraints[0]
    assert rows["posts"].owner == "author_id" and rows["posts"].scope == "author" and rows["posts"].schema is None
    assert blog.execute({"op": "schema", "entity": "users"}).version == 1 and blog.execute({"op": "constraints", "entity": "users"}) == [NotNull("users", "name")]
    with pytest.raises(NotFound):
        blog.execute({"op": "schema", "entity": "nope"})


def test_cascade_work_is_limited(spark):
    nodes = spark.range(60).select(F.col("id").cast("string").alias("id"), ((F.col("id") - 1) / 3).cast("bigint").cast("string").alias("parent")).withColumn("parent", F.when(F.col("id") != "0", F.col("parent")))
    rule = ForeignKey("nodes", "parent", "nodes", on_delete=OnDelete.CASCADE)
    root = nodes.filter("id = '0'")
    assert constraints.cascade({"nodes": (nodes, "id")}, [rule], "nodes", root, work=59)["nodes"].count() == 60
    with pytest.raises(LimitExceeded):
        constraints.cascade({"nodes": (nodes, "id")}, [rule], "nodes", root, work=58)


def test_a_null_is_told_in_events(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), ("c", 2, "z")], "id string, n int, s string")
    new = old.withColumn("n", F.when(F.col("id") == "a", F.lit(None)).otherwise(F.col("n"))).filter("id != 'c'")
    assert {r.id: (r.operation, r.data) for r in mutate.changes(old, new, "e").collect()} == {"a": ("Update", '{"id":"a","n":null,"s":"x"}'), "c": ("Delete", '{"id":"c","n":2,"s":"z"}')}
    wider = new.withColumn("more", F.lit(None).cast("int"))
    assert {r.id for r in mutate.changes(new, wider, "e").collect()} == {"a", "b"}


def test_sortable_doubles_and_mixed_values(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e9, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scalars.sortable_double(F.col("v")).alias("k"))
    assert [r.i for r in sorted(rows.collect(), key=lambda r: r.k)] == list(range(len(values)))
    docs = ["null", "false", "true", "-3", "2.5", "10", '"a"', '"b"', "[1]", '{"a":1}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", F.parse_json("d").alias("v"))
    assert [r.i for r in df.orderBy(*scalars.order_of(F.col("v"))).collect()] == list(range(len(docs)))
    with pytest.raises(Exception, match="cannot be indexed"):
        df.select(scalars.index_value(F.col("v"))).collect()


def test_document_source_writes(spark, tmp_path):
    spark.dataSource.register(stores.DocumentSource)
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(str(i), f"é{i}" if i % 3 else None) for i in range(20)], "id string, data string")
    rows.write.format("quernel").mode("append").save(path)
    rows.limit(2).withColumn("id", F.lit("x")).write.format("quernel").mode("append").save(path)
    read = lambda: spark.read.format("quernel").load(path)
    assert read().count() == 22 and sorted(map(tuple, read().filter("id != 'x'").collect())) == sorted(map(tuple, rows.collect()))
    rows.limit(3).write.format("quernel").mode("overwrite").save(path)
    assert read().count() == 3 and not list((tmp_path / "store").glob("*.part"))


def test_matching_splits_patterns_by_their_wildcards(spark):
    topics = ["a", "a/b", "a/b/c", "b", "b/c", "$s/x", "x/b", "a.b/c", "a//c", ""]
    patterns = ["a", "a/b", "a/#", "+/b", "#", "b/+", "+", "a/+/c", "x/b/#", "a.b/c", "$s/#"]
    events = spark.createDataFrame([(i, "e" if i % 2 else "f", t) for i, t in enumerate(topics)], "n int, entity string, topic string")
    subs = spark.createDataFrame([(f"s{i}", p, "e" if i % 4 == 3 else None, None, "broadcast") for i, p in enumerate(patterns)], "subscription_id string, pattern string, entity string, share_group string, mode string")

    def fits(t, p):
        a, b = t.split("/"), p.split("/")
        for i, x in enumerate(b):
            if x == "#":
                return True
            if i >= len(a) or x not in ("+", a[i]):
                return False
        return len(a) == len(b)

    want = {(i, f"s{j}") for i, t in enumerate(topics) for j, p in enumerate(patterns) if fits(t, p) and (j % 4 != 3 or i % 2)}
    assert {(r.n, r.subscription_id) for r in routing.matches(events, subs).collect()} == want
    with pytest.raises(QuernelError):
        routing.matches(events, subs, config=Config(subscriptions=10))


def test_written_folders_can_be_cleared(spark):
    constraints.clear(spark)
    df = constraints.written(spark.range(5), "some")
    (path,) = constraints._MADE
    assert df.count() == 5 and constraints.clear(spark) == 1 and not constraints._MADE
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_backends(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", 1.5, True), ("2", None, None, None)], "id string, s string, x double, b boolean")
    key = F.lit("0123456789abcdef").cast("binary")
    for store in (backends.MemoryBackend(), backends.ParquetBackend(spark, f"file://{tmp_path}/p"), backends.SealedBackend(backends.ParquetBackend(spark, f"file://{tmp_path}/s"), key)):
        assert store.names() == []
        with pytest.raises(NotFound):
            store.read("t")
        store.write("t", rows)
        store.write("t", store.read("t").unionByName(rows.filter("id = '1'").withColumn("id", F.lit("3"))))
        assert store.names() == ["t"] and store.read("t").schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(tuple, store.read("t").collect())) == [("1", "a", 1.5, True), ("2", None, None, None), ("3", "a", 1.5, True)]
    assert spark.read.parquet(f"file://{tmp_path}/s/t").filter("s = 'a'").count() == 0
    with pytest.raises(Exception, match="AES|decrypt|tag|CRYPTO"):
        backends.SealedBackend(store.inner, F.lit("fedcba9876543210").cast("binary")).read("t").collect()
