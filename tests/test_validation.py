"""What no query may be built from."""

import pytest

from relquery.functions import expressions as ex
from relquery.functions import names as nm
from relquery.functions.names import InvalidArgument
from relquery.query import Query


@pytest.mark.parametrize("name", ["a", "a.b", "_x1", "a" * 64])
def test_columns(name):
    assert nm.is_column(name)


@pytest.mark.parametrize("name", ["", "1a", "a.b.c", "a b", "a;b", "drop", "t.select", "xp_cmd", "a" * 65, None, "a--b"])
def test_no_columns(name):
    assert not nm.is_column(name)


def test_relations():
    assert nm.table_and_alias("t") == ("t", "t") and nm.table_and_alias("t AS x") == ("t", "x") and nm.table_and_alias("`t` x") == ("t", "x")
    for bad in ("", "t x y", "t OR x", "(select 1) x", "t bad-alias!", 3):
        with pytest.raises(InvalidArgument):
            nm.table_and_alias(bad)
    for bad in ({"a": "x", "b": "y"}, {}, {"a": "bad-alias!"}):
        with pytest.raises(InvalidArgument):
            nm.relation(bad)
    with pytest.raises(InvalidArgument):
        nm.key_pairs(["a", "b"], "c")


@pytest.mark.parametrize("text", ["price * qty", "COALESCE(a, 0) + b", "CASE WHEN a = 1 AND b = 2 THEN 1 ELSE 0 END", "ROUND(a / b, 2)"])
def test_custom_expressions(text):
    assert ex.is_custom(text) and ex.is_calculation(text)


@pytest.mark.parametrize(
    "text",
    ["", "SUM(value", "sleep(0)", "a; b", "a -- b", "a /* b */", "1 HAVING 1", "a OR b", "SUM(a) OR 1=1 CASE WHEN 1=1 THEN 1 END", "SUM(value) UNION SELECT 1", "a" * 2001, "a IN (1)", "a || b", "HOUR(a)", '"sleep"(5)', "a INTO b", ")a(", "a != b"],
)
def test_refused_expressions(text):
    assert not ex.is_custom(text) and not ex.is_calculation(text)


def test_calculations_allow_more():
    assert ex.is_calculation("SUM(a) % 2 + POW(b, 2)") and not ex.is_custom("SUM(a) % 2")
    assert ex.is_calculation("COUNT(DISTINCT a)") and ex.is_calculation("SUM(CASE WHEN a = 'x' THEN 1 ELSE 0 END)")
    assert not ex.is_calculation("a OUTFILE b")


@pytest.mark.parametrize(
    "text, value",
    [("1 / 0", None), ("6 / 3 / 2", 1.0), ("7 % 0", None), ("MOD(7, 4)", 3), ("-3 / (1 + 2) * 2", -2.0), ("10 / POW(2, 1)", 5.0), ("CAST('5' AS SIGNED) + 1", 6), ("CONVERT('5', CHAR)", "5"), ("IF(1 < 2, 4 / CASE WHEN 1 = 1 THEN 2 END, 0)", 2.0), ("LENGTH(CURTIME())", 8), ("CONCAT(\"a\", 'b')", "ab")],
)
def test_expressions_in_spark(spark, text, value):
    assert spark.sql(f"select {ex.to_spark(text)}").first()[0] == value


def test_builders_refuse(db):
    q = lambda: db.query_on("people")
    keys = ("person_id", "id")
    for bad in (
        lambda: q().where_in("a" * 65, [1]),
        lambda: q().where_between("id", [1]),
        lambda: q().order_by_sequence("category; DROP", ["A"]),
        lambda: q().with_({"scores": "bad-alias!"}, *keys),
        lambda: q().with_("scores", *keys, "yes"),
        lambda: q().with_({"a": "b", "c": "d"}, *keys),
        lambda: q().where_exists("not callable"),
        lambda: q().where_exists_relation("scores", *keys, "not callable"),
        lambda: q().where_has("scores", *keys, None, "~", 1),
        lambda: q().or_where_has("scores", *keys, None, ">=", -1),
        lambda: q().join_sum("scores", *keys, None),
        lambda: q().join_sum("scores", *keys, "value; DROP TABLE t"),
        lambda: q().join_calculation("scores", *keys, "SUM(value) UNION SELECT 1"),
        lambda: q().with_calculation({"scores": "x"}, *keys, "SUM(value"),
        lambda: q().with_avg({"scores": "x"}, *keys, "sleep(0)", True),
        lambda: q().with_sum({"(SELECT 1) s": "x"}, *keys, "value"),
        lambda: q().select_sum("sum(x)"),
        lambda: Query(db).get(),
        lambda: db.drop_table("missing"),
        lambda: db.transaction("not callable"),
    ):
        with pytest.raises(InvalidArgument):
            bad()


def test_an_error_in_a_callback_leaves_the_builder_usable(db):
    q = db.query_on("people")
    with pytest.raises(RuntimeError):
        q.where_exists(lambda s: (_ for _ in ()).throw(RuntimeError("inside")))
    assert q.where("id", 1).get().num_rows() == 1
