import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.functions import predicates as P
from quernel.operators import listing
from quernel.plans.model import Filter, ForeignKey, LimitExceeded, ListRequest, Missing, Op, QuernelError, Schema, SchemaViolation, parse_derived, parse_pairs, valid_entity, valid_id

USERS = [("Alice", "alice@example.com", "active", "admin", 30), ("Bob", "bob@example.com", "active", "user", 25), ("Charlie", "charlie@example.com", "inactive", "user", 35), ("David", "david@example.com", "pending", None, 28)]
PRODUCTS = [("Laptop", 999, "electronics", 50), ("Mouse", 29, "electronics", 200), ("Desk", 299, "furniture", 25), ("Chair", 199, "furniture", 0), ("Keyboard", 79, "electronics", 150)]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "name string, email string, status string, role string, age bigint").withColumn("id", F.col("name"))


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, "name string, price bigint, category string, stock bigint").withColumn("id", F.col("name"))


def names(df):
    return {r["name"] for r in df.collect()}


@pytest.mark.parametrize(
    ("field", "op", "value", "want"),
    [
        ("status", "in", ["active", "pending"], {"Alice", "Bob", "David"}),
        ("email", "like", "*@example.com", {"Alice", "Bob", "Charlie", "David"}),
        ("name", "~", "*li*", {"Alice", "Charlie"}),
        ("role", "?", None, {"David"}),
        ("role", "is_not_null", None, {"Alice", "Bob", "Charlie"}),
        ("role", "neq", "user", {"Alice", "David"}),
        ("role", "in", ["admin", None], {"Alice", "David"}),
        ("role", "in", [], set()),
        ("role", "in", "admin", set()),
        ("age", "gt", "25", set()),
        ("age", "eq", "30", set()),
        ("age", "neq", "30", {"Alice", "Bob", "Charlie", "David"}),
        ("role", "lte", None, set()),
        ("absent", "neq", 1, set()),
        ("absent", "is_null", None, set()),
    ],
)
def test_filters(users, field, op, value, want):
    assert names(listing.where(users, [Filter.of(field, op, value)])) == want


def test_cursor_rules(users):
    at = lambda *f: names(listing.where(users, [Filter.of(*f)], Missing.CURSOR))
    assert len(at("absent", "neq", 1)) == 4 and len(at("absent", "is_null")) == 4 and at("role", "lte", None) == {"David"}
    assert len(names(listing.where(users, [Filter.of("absent", "is_null")], Missing.DOCUMENT))) == 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("category=electronics", {"Laptop", "Mouse", "Keyboard"}),
        ("category<>electronics", {"Desk", "Chair"}),
        ("price>100", {"Laptop", "Desk", "Chair"}),
        ("price<100", {"Mouse", "Keyboard"}),
        ("price>=199", {"Laptop", "Desk", "Chair"}),
        ("stock<=25", {"Desk", "Chair"}),
        ("name~*board*", {"Keyboard"}),
        ("category=electronics,price<100", {"Mouse", "Keyboard"}),
        ("price>50,price<200", {"Chair", "Keyboard"}),
        ("price>100,price<50", set()),
    ],
)
def test_written_filters(products, text, want):
    assert names(listing.where(products, P.parse_filters(text))) == want


def test_literals_and_spellings():
    assert [P.literal(x) for x in ("5", "1.5", "true", "x", "")] == [5, 1.5, True, "x", ""]
    assert P.parse_filters("a!?") == (Filter("a", Op.IS_NOT_NULL),) and P.parse_filters("label=") == (Filter("label", Op.EQ, ""),)
    assert P.store_filter("id='a b'") == ("id", "a b") and P.store_filter("x=1") is None and P.store_filter(None) is None
    for bad in ("novalue", "=x"):
        with pytest.raises(QuernelError):
            P.parse_filters(bad)
    with pytest.raises(QuernelError):
        Filter.of("a", "between", 1)


def test_globs_equal_their_expressions(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab*.\n") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for glob in ("", "*", "a*", "*a", "*a*", "a", "a*b", "*a*b*", "**", "a.b", "*.*", "a\nb*"):
        want = [w for w in words if re.fullmatch(".*".join(map(re.escape, glob.split("*"))), w, re.S)]
        assert sorted(r.w for r in df.filter(P.glob_match(F.col("w"), glob)).collect()) == sorted(want), glob


def topic_fits(pattern, topic):
    def go(p, t):
        if not p:
            return not t
        if p[0] == "#":
            return any(go(p[1:], t[i:]) for i in range(len(t) + 1))
        return bool(t) and (p[0] in ("+", t[0])) and go(p[1:], t[1:])

    return go(pattern.split("/"), topic.split("/"))


def test_topics(spark):
    rng = random.Random(2)
    pick = lambda alphabet: "/".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
    pairs = [(pick(["a", "b.c", "+", "#", ""]), pick(["a", "b.c", "bxc", ""])) for _ in range(600)] + [("users/+", "users/123"), ("users/#", "users/123/profile"), ("+/123", "users/123"), ("users/+", "users/123/profile")]
    for pattern, topic in pairs:
        assert bool(re.search(P.topic_regex(pattern).replace(r"\z", r"\Z"), "/" + topic)) == topic_fits(pattern, topic), (pattern, topic)
    df = spark.createDataFrame(pairs, "pattern string, topic string")
    got = df.select("pattern", "topic", F.rlike(F.concat(F.lit("/"), "topic"), P.topic_regex_of(F.col("pattern"))).alias("fits")).collect()
    assert all(r.fits == topic_fits(r.pattern, r.topic) for r in got)
    assert not re.search(P.topic_regex("#", system=False).replace(r"\z", r"\Z"), "/$SYS/x")
    assert [P.valid_pattern(x) for x in ("a/+/#", "a/#/b", "a+", "", "#")] == [True, False, False, False, True]


def test_limits_sorts_pages_and_projection(spark, users):
    plan = lambda r, **k: listing.plan(users, r, **k)
    request = ListRequest("users")
    for i in range(16):
        request = request.where("age", "neq", i)
    plan(request)
    with pytest.raises(LimitExceeded):
        plan(request.where("age", "neq", 99))
    with pytest.raises(LimitExceeded):
        plan(request, owner=("name", "Bob"))
    with pytest.raises(LimitExceeded):
        plan(ListRequest("users").order("a").order("b").order("c").order("d").order("e"))
    page = lambda n, at: [r.name for r in plan(ListRequest("users").order("age").page(n, at)).collect()]
    assert page(2, 0) == ["Bob", "David"] and page(2, 3) == ["Charlie"] and page(2, 9) == []
    assert [r.name for r in plan(ListRequest("users").order("role", True)).collect()][-1] == "David"
    assert [r.name for r in plan(ListRequest("users").order("role")).collect()][0] == "David"
    assert plan(ListRequest("users").project("age", "nope", "id")).columns == ["id", "age"]
    assert plan(ListRequest("users", cap=3, offset=5, limit=2)).count() == 0
    schema = Schema("users", {"name": None})
    for bad in (ListRequest("users").where("x", "eq", 1), ListRequest("users").order("x"), ListRequest("users").project("x")):
        with pytest.raises(SchemaViolation):
            plan(bad, schema=schema)
    assert {r.name for r in plan(ListRequest("users"), owner=("name", "Bob")).collect()} == {"Bob"}


def test_requests_from_json():
    r = ListRequest.parse("e", {"filters": [{"field": "a", "op": ">", "value": 1}], "sort": [{"field": "b", "direction": "desc"}], "pagination": {"limit": 5, "offset": 2}, "projection": ["a"]})
    assert r == ListRequest("e", limit=5, offset=2).where("a", "gt", 1).order("b", True).project("a")
    assert ListRequest.parse("e", {"limit": 3}).limit == 3
    for bad in ({"filters": [{"op": "eq"}]}, {"filters": [{"field": "a", "op": "what"}]}, {"sort": ["a"]}):
        with pytest.raises(QuernelError):
            ListRequest.parse("e", bad)
    assert parse_pairs("a=b, c=d") == {"a": "b", "c": "d"} and parse_derived("child=fk>parent") == {"child": ("fk", "parent")}
    assert valid_entity("a-b_1") and not valid_entity("a/b") and valid_id("x") and not valid_id("a/b") and not valid_id("")
    assert ForeignKey("a", "b", "c").target_field == "id"


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = listing.plan(orders, ListRequest("orders").where("o_orderstatus", "eq", "F").where("o_totalprice", "gt", 5).project("o_orderkey"), "o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text or "EqualNullSafe(o_orderstatus,F)" in text
    assert "GreaterThan(o_total" in text
    assert "o_orderdate" not in text.rpartition("ReadSchema")[2]
