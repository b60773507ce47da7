"""Rows and shapes that queries give on a small fixture."""

import warnings

import pytest

from relquery.functions.names import InvalidArgument
from relquery.operators.writes import Raw
from relquery.query import Query
from relquery.session import Session

KEYS = ("person_id", "id")


def names(q):
    return [r["name"] for r in q.get().result_array()]


@pytest.fixture
def people(db):
    return lambda: db.query_on("people").order_by("id")


def test_rows_and_count(people):
    result = people().get()
    assert result.num_rows() == 3 and result.row().name == "Alice" and result.row_array(2)["name"] == "Charlie" and result.row(3) is None


def test_call_order_decides(people):
    q = people().where("category", "Z").or_where_has("scores", *KEYS, None, ">=", 3).where("id", 999)
    assert names(q) == []
    q = people().where("id", 999).or_where("category", "B").where_exists_relation("profiles", *KEYS)
    assert names(q) == ["Bob"]


def test_existence_splits_people(people):
    assert names(people().where_exists_relation("scores", *KEYS)) == ["Alice"]
    assert names(people().where_not_exists_relation("scores", *KEYS)) == ["Bob", "Charlie"]
    assert names(people().where_exists_relation("scores AS s", "s.person_id", "id")) == ["Alice"]
    assert names(people().where_has("scores", *KEYS, ">=")) == ["Alice"]
    assert names(people().where_has("scores", *KEYS, "=", 0)) == ["Bob", "Charlie"]


def test_existence_written_out_with_a_nested_relation_that_names_the_outermost_table(people):
    def sub(q):
        q.select("1").from_("scores").where("scores.person_id = people.id").where_exists_relation("category_scores", "person_id", "people.id")

    assert names(people().where_exists(sub)) == ["Alice"]
    assert names(people().where_not_exists(sub)) == ["Bob", "Charlie"]
    assert names(people().where("id", 2).or_where_exists(sub)) == ["Alice", "Bob"]


def test_existence_inside_a_relation(people):
    def sub(q):
        q.where_exists(lambda n: n.from_("category_scores").where("category_scores.person_id = scores.person_id").where_exists_relation("people", "id", "category_scores.person_id", lambda p: p.where("id", 999)))

    assert people().where("id", 1).with_many("scores", *KEYS, sub).get().row().scores == []


def test_uncorrelated_existence(people):
    assert len(names(people().where_exists(lambda q: q.from_("scores").where("value", 50)))) == 3
    assert names(people().where_exists(lambda q: q.from_("scores").where("value", 51))) == []


def test_aggregate_filter_inside_a_count(people):
    q = people().where_has("scores", *KEYS, lambda s: s.with_sum({"category_scores": "total"}, "person_id", "scores.person_id", "value").where_aggregate("total >", 99999), ">=", 1)
    assert names(q) == []


def test_first_condition_of_a_group_may_be_a_relation(people):
    q = people().where("id <", 3).group(lambda g: g.where_has("scores", *KEYS).or_where("name", "Bob"))
    assert names(q) == ["Alice", "Bob"]
    q = people().or_group(lambda g: g.where_doesnt_have("scores", *KEYS)).where("category", "A")
    assert names(q) == ["Charlie"]


def test_groups(people):
    assert names(people().group(lambda g: None).where("id", 1)) == ["Alice"]
    assert names(people().where("id", 1).or_group(lambda g: g.where("category", "A").where("id >", 1))) == ["Alice", "Charlie"]
    assert names(people().not_group_start().where("id", 1).or_where("id", 2).group_end()) == ["Charlie"]


def test_group_closes_after_an_error(db):
    q = db.query_on("people")
    with pytest.raises(RuntimeError):
        q.group(lambda g: (_ for _ in ()).throw(RuntimeError()))
    assert q.where("id", 1).get().num_rows() == 1


def test_nulls_and_operators(db, spark):
    db.tables["t"] = spark.createDataFrame([(1, None), (2, "x")], "id long, c string")
    ids = lambda q: sorted(r["id"] for r in q.get().result_array())
    t = lambda: db.query_on("t")
    assert ids(t().where("c", None)) == [1] and ids(t().where("c !=", None)) == [2] and ids(t().where_not("c", None)) == []
    assert ids(t().where_in("id", [])) == [] and ids(t().where_not_in("id", [])) == [1, 2]
    assert ids(t().where_not_in("id", [1, None])) == []
    assert ids(t().where("c <> 'y'")) == [2] and ids(t().where({"id >=": 1, "c": "x"})) == [2]
    assert ids(t().where("id", "2")) == [2] and ids(t().where("id", True)) == [1]


def test_like_takes_wildcards_as_text(db, spark):
    db.tables["t"] = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, "A_b\\")], "id long, c string")
    ids = lambda q: sorted(r["id"] for r in q.get().result_array())
    assert ids(db.query_on("t").like("c", "a%")) == [1]
    assert ids(db.query_on("t").like("c", "A", "after")) == [1, 2, 3]
    assert ids(db.query_on("t").like("c", "_")) == [3] and ids(db.query_on("t").like("c", "b\\", "before")) == [3]
    assert ids(db.query_on("t").search("X", ["c", ""])) == [2]


def test_when_and_unless(people):
    assert names(people().when(0, lambda q: q.where("id", 1), lambda q: q.where("id", 2))) == ["Bob"]
    assert names(people().unless(lambda q: False, lambda q: q.where("id", 3))) == ["Charlie"]


def test_aggregates_without_match(people):
    def totals(q):
        q.with_count("scores", *KEYS).with_sum({"scores": "total"}, *KEYS, "value").with_calculation({"scores": "n1"}, *KEYS, "COUNT(*) + 1")
        return q.join_count({"scores": "joined"}, *KEYS).get().result_array()

    a, b, _ = totals(people())
    assert (a["scores_count"], a["total"], a["n1"], a["joined"]) == (3, 90, 4, 3)
    assert (b["scores_count"], b["total"], b["n1"], b["joined"]) == (0, None, 1, None)


def test_aggregate_with_callback_and_expression(people):
    q = people().with_sum({"scores": "x"}, *KEYS, "value * 2", True, lambda s: s.where("value >", 10)).with_max("scores", *KEYS, "value", lambda s: s.where("value <", 50))
    assert [(r["x"], r["scores_max"]) for r in q.get().result_array()] == [(160, 30), (None, None), (None, None)]


def test_calculation_of_one_row(people):
    q = people().where("id", 1).with_calculation({"scores": "plus"}, *KEYS, "value + 5", lambda s: s.where("value", 10))
    assert q.get().row().plus == 15
    with pytest.raises(Exception, match="more than one row"):
        people().with_calculation({"scores": "plus"}, *KEYS, "value + 5").get().result()


def test_aggregate_over_the_same_table(people):
    q = people().with_count({"people AS other": "same"}, "other.category", "category")
    assert [r["same"] for r in q.get().result_array()] == [2, 1, 2]


def test_where_aggregate(people):
    base = lambda: people().with_sum({"scores": "total"}, *KEYS, "value")
    assert names(base().where_aggregate("total =", 0)) == ["Bob", "Charlie"]
    assert names(base().where_aggregate("total BETWEEN", [80, 100]).or_where_aggregate("total NOT BETWEEN", [-1, 100])) == ["Alice"]
    for bad in ([1], [1, 2, 3]):
        with pytest.raises(InvalidArgument):
            base().where_aggregate("total BETWEEN", bad)
    with pytest.raises(InvalidArgument):
        people().where_aggregate("unknown >", 1)


def test_relations(people):
    q = people().with_one({"scores": "best"}, *KEYS, lambda s: s.order_by("value", "DESC")).with_many("scores", *KEYS, lambda s: s.select("value").order_by("value"))
    a, b, _ = q.get().result()
    assert a.best.value == 50 and [s.value for s in a.scores] == [10, 30, 50]
    assert b.best is None and b.scores == []


def test_composite_keys_and_nesting(people):
    q = people().where("id", 1).with_many("category_scores", ["person_id", "category"], ["id", "category"]).with_many({"scores": "kept_sum"}, *KEYS, lambda s: s.with_one({"people": "owner_sum"}, "id", "person_id"))
    row = q.get().row()
    assert len(row.category_scores) == 2 and row.kept_sum[0].owner_sum.name == "Alice"


def test_relation_keys_that_are_not_selected(people):
    rows = people().select("name").with_many("scores", *KEYS, lambda s: s.select("value")).get().result_array()
    assert set(rows[0]) == {"name", "scores"} and set(rows[0]["scores"][0]) == {"value"}


def test_limits_in_relations(people):
    one = people().with_many("scores", *KEYS, lambda s: s.order_by("value").limit(2)).get().result()
    assert [len(r.scores) for r in one] == [2, 0, 0]
    per = people().with_many("scores", *KEYS, lambda s: s.order_by("value DESC").limit_per_parent(1)).get().result()
    assert [s.value for s in per[0].scores] == [50]


def test_relation_after_grouping(db):
    q = db.query_on("scores").select("person_id, COUNT(*) AS n").group_by("person_id").with_one("people", "id", "person_id")
    row = q.get().row()
    assert row.n == 3 and row.people.name == "Alice"


def test_group_having(db):
    q = db.query_on("people").select("category, COUNT(*) AS n").group_by("category").order_by("category")
    assert q.copy().having("n >", 1).get().result_array() == [{"category": "A", "n": 2}]
    assert q.copy().having("COUNT(*) <", 2).or_having("max(id) = 3").get().num_rows() == 2
    assert db.query_on("people").select("category, COUNT(*) as count").group_by("category").get().key_by("count").keys() == {1, 2}
    assert q.copy().having("n >", 1).count_all_results() == 1


def test_orders(people, db):
    order = lambda q: [r["name"] for r in q.get().result_array()]
    on = lambda: db.query_on("people").select("name")
    assert order(on().order_by_relation("profiles", *KEYS, "rank", "DESC")) == ["Bob", "Charlie", "Alice"]
    assert order(on().order_by_relation("profiles", *KEYS, "rank")) == ["Alice", "Charlie", "Bob"]
    assert order(on().order_by_sequence("category", ["B"]).order_by("id DESC")) == ["Bob", "Charlie", "Alice"]
    assert order(on().latest("id").limit(1)) == ["Charlie"] and order(on().oldest("id").limit(1, 1)) == ["Bob"]
    assert order(db.query_on("people").select("name").with_count({"scores": "n"}, *KEYS).order_by("n DESC, id").limit(1)) == ["Alice"]
    for bad in ([], "x"):
        with pytest.raises(InvalidArgument):
            db.query_on("people").order_by_sequence("category", bad)


def test_duplicate_names_keep_the_last(db):
    row = db.query_on("people p").join("profiles f", "f.person_id = p.id").where("p.id", 2).get().row_array()
    assert row["id"] == 2 and row["rank"] == 30 and len(row) == 6


def test_pages(people):
    first, last = people().paginate(2, 1).get(), people().paginate(2, 2).get()
    facts = lambda r: (r.found_rows(), r.last_page(), r.from_(), r.to(), r.has_more_pages(), r.num_rows())
    assert facts(first) == (3, 2, 1, 2, True, 2) and facts(last) == (3, 2, 3, 3, False, 1)
    assert first.to_pagination_array()["total"] == 3
    assert people().get().current_page() is None
    assert people().paginate(2).get(limit=1).num_rows() == 1
    empty = people().where("id", 9).paginate(2).get()
    assert (empty.last_page(), empty.from_(), empty.to()) == (1, None, None)
    kept = people().with_many("scores", *KEYS).calc_rows().get(limit=1)
    assert kept.found_rows() == 3 and isinstance(kept.row().scores, list)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(InvalidArgument):
            people().paginate(*bad)


def test_chunks(people, db):
    calls = []
    assert people().chunk(2, lambda rows: calls.append([r.id for r in rows])) == 3 and calls == [[1, 2], [3]]
    assert people().chunk(3, lambda rows: calls.append(rows)) == 3 and len(calls) == 3
    assert people().chunk(1, lambda rows: False) == 0
    seen = []
    assert people().where("category", "A").or_where("id", 2).chunk_by_id(1, lambda rows: seen.append(rows[0].id), "id") == 3 and seen == [1, 2, 3]
    with pytest.raises(InvalidArgument):
        people().select("name").chunk_by_id(1, lambda rows: None, "id")
    with pytest.raises(InvalidArgument):
        people().chunk(0, print)


def test_results(people, db):
    r = people().get()
    assert r.key_by("category")["A"].id == 3 and r.key_by(lambda p: p.name.lower(), True)["bob"]["id"] == 2
    with pytest.raises(TypeError):
        r.key_by(lambda p: [p.id])
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert list(r.key_by("missing")) == [0, 1, 2]
    assert db.query_on("people").where("id", 99).get().key_by("id") == {} and r.value("missing") is None
    assert r.next_row().id == 2 and r.previous_row().id == 1 and r.last_row("array")["id"] == 3 and r.first_row().id == 1
    assert r.unbuffered_row().id == 1 and r.list_fields()[0] == "id" and r.num_fields() == 4
    made = r.custom_result_object(type("Person", (), {}))
    assert made[1].name == "Bob"
    r.set_row("name", "Al")
    assert r.row_array()["name"] == "Al"
    assert people().pluck("name") == ["Alice", "Bob", "Charlie"]
    assert people().with_one("profiles", *KEYS).pluck("profiles.rank") == [10, 30, 20]
    assert people().value("name") == "Alice" and people().first().id == 1 and people().where("id", 9).first() is None
    assert people().exists() and people().where("id", 9).doesnt_exist() and people().count_all_results() == 3
    with pytest.raises(AttributeError):
        r.no_such_method()


def test_raw_queries(db):
    r = db.query("select * from people where id = ? and name <> 'a?b'", [1], Query(db).with_many("scores", *KEYS))
    assert len(r.row().scores) == 3
    assert db.query("update people set category = 'Q' where id = 1") is True
    assert db.query_on("people").where("category", "Q").count_all_results() == 1
    assert db.query("insert into people (id, name) values (9, 'Zed')") and db.query("delete from people where id = 9")
    assert db.count_all("people") == 3 and db.compile_binds("a ? ?", [1]) == "a ? ?"
    assert db.last_query() and db.total_queries() >= 4 and db.elapsed_time() >= 0


def test_writes(db):
    db.insert("people", {"id": 4, "name": "Dan"})
    assert db.insert_batch("people", [{"id": 5, "name": "E"}, {"id": 6, "name": "F"}]) == 2
    with pytest.raises(InvalidArgument):
        db.insert_batch("people", [{"id": 1}, {"name": "x"}])
    with pytest.raises(InvalidArgument):
        db.insert("people", {"nope": 1})
    db.update("people", {"name": "X", "id": Raw("id + 10")}, lambda q: q.where("category", "A"))
    assert sorted(db.query_on("people").where("name", "X").pluck("id")) == [11, 13]
    db.update("people", {"name": "Y"}, {"id >": 0}, 1)
    assert db.query_on("people").where("name", "Y").count_all_results() == 1
    db.update_batch("people", [{"id": 4, "name": "D4"}, {"id": 5, "email": "e@x"}], "id")
    assert db.query_on("people").where("id", 5).first().name == "E" and db.query_on("people").where("id", 4).first().name == "D4"
    db.delete("people", {"category": "A"})
    assert db.count_all("people") == 4, "null categories stay"
    with pytest.raises(InvalidArgument):
        db.delete("people")
    db.replace("people", {"id": 4, "name": "R"}, "id")
    assert db.query_on("people").where("id", 4).first().email is None and db.count_all("people") == 4
    db.truncate("people")
    assert db.count_all("people") == 0


def test_transactions(db):
    assert db.transaction(lambda d: d.insert("people", {"id": 7, "name": "T"}) and "value") == "value" and db.count_all("people") == 4

    def fails(d):
        d.delete("people", {"id": 7})
        raise KeyError("no")

    assert db.transaction(fails) is False and db.count_all("people") == 4
    with pytest.raises(KeyError):
        db.transaction(fails, strict=True)
    db.trans_begin()
    db.trans_begin()
    db.truncate("people")
    db.trans_rollback()
    assert db.count_all("people") == 0 and db.trans_active()
    db.trans_rollback()
    assert db.count_all("people") == 4 and not db.trans_active()
    db.trans_start()
    db.truncate("scores")
    db.trans_fail()
    assert db.trans_complete() is False and db.count_all("scores") == 3


def test_tables(db):
    db.add_field("id")
    db.add_field({"label": {"type": "VARCHAR", "constraint": 5}})
    db.create_table("made")
    db.insert_batch("made", [{"label": "a"}, {"label": "b"}])
    db.insert("made", {"label": "c"})
    assert sorted(db.query_on("made").pluck("id")) == [1, 2, 3]
    db.add_column("made", {"n": {"type": "INT", "default": 4}})
    db.modify_column("made", {"n": {"type": "BIGINT", "name": "m"}})
    assert db.field_exists("m", "made") and db.field_data("made")[2]["type"] == "bigint"
    db.rename_table("made", "other")
    assert db.table_exists("other") and not db.table_exists("made")
    db.drop_table("other")
    assert db.drop_table("other", True) and "people" in db.list_tables()


def test_prefix(db, spark):
    db.tables["p_t"] = spark.range(2)
    db.set_dbprefix("p_")
    assert db.query_on("t").get().num_rows() == 2


def test_text(db):
    q = db.query_on("people").select("id").where("id", 1).or_where_has("scores", *KEYS, op=">", n=2).order_by("id").limit(3)
    assert q.get_compiled_select() == "SELECT id FROM people WHERE id = 1 OR (SELECT COUNT(*) FROM scores WHERE scores.person_id = people.id) > 2 ORDER BY id ASC LIMIT 3"
    assert db.get_compiled_delete("people", {"name": "O'x"}) == "DELETE FROM people WHERE name = 'O\\'x'"


def test_plans_push_filters_and_columns(spark, tmp_path):
    from relquery.session import Session

    spark.range(10).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(f"{tmp_path}/t.parquet")
    plan = Session(spark, folder=str(tmp_path)).query_on("t").select("b").where("id >", 3).to_df()._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_aggregates_over_one_relation_share_a_scan(db):
    q = db.query_on("people").with_count("scores", *KEYS).with_sum("scores", *KEYS, "value").with_max("scores", *KEYS, "value")
    assert q.to_df()._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    only = db.query_on("people").where_has("scores", *KEYS)
    assert "LeftSemi" in only.to_df()._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_reads_related_rows_of_its_own_keys_only(people):
    q = people().select("name").limit(2).with_many("scores", *KEYS, lambda s: s.order_by("value"))
    frame = q.to_df()
    assert "LeftSemi" in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.name, [s.value for s in r.scores]) for r in frame.collect()] == [("Alice", [10, 30, 50]), ("Bob", [])]


def test_recorded_clauses_outlive_a_reset(people, db):
    q = db.query_on("people").start_cache().where("category", "A").select("id").stop_cache()
    q.where("id >", 1).order_by("id")
    assert q.pluck("id") == [3]
    q.reset_query()
    q.from_("people").order_by("id")
    assert q.pluck("id") == [1, 3]
    q.flush_cache().reset_query()
    assert q.from_("people").order_by("id").pluck("id") == [1, 2, 3]
    with pytest.raises(InvalidArgument):
        db.query_on().pluck("id")


def test_queued_writes(db):
    q = db.query_on("people")
    assert q.set("name", "Dora").set({"id": 4, "category": "B"}).insert()
    assert db.affected_rows == 1 and db.count_all("people") == 4
    q.from_("people").set("name", "upper(name)", False).where("category", "B").update()
    assert db.affected_rows == 2 and sorted(db.query_on("people").pluck("name")) == ["Alice", "BOB", "Charlie", "DORA"]
    q.set_insert_batch([{"id": 5, "name": "E"}, {"id": 6, "name": "F"}]).set_insert_batch({"id": 7, "name": "G"})
    assert q.insert_batch("people") == 3 and db.count_all("people") == 7
    assert q.set_update_batch([{"id": 5, "name": "Eve"}, {"id": 99, "name": "none"}], "id").update_batch("people") == 1
    assert db.query_on("people").where("id", 5).value("name") == "Eve"
    q.from_("people").where("id >", 4).delete()
    assert db.affected_rows == 3 and db.count_all("people") == 4
    assert q.set({"id": 1, "name": "Al"}).replace("people", key="id") and db.query_on("people").where("id", 1).value("name") == "Al"
    for bad in (lambda: q.from_("people").delete(), lambda: q.insert("people"), lambda: q.set("a b", 1), lambda: db.query_on().set("name", "x").update()):
        with pytest.raises(InvalidArgument):
            bad()


def test_raw_replace_and_affected_rows(db):
    db.query("REPLACE INTO profiles (id, person_id, rank) VALUES (1, 1, 77), (9, 9, 9), (9, 9, 10)")
    assert db.affected_rows == 2 and sorted((r["id"], r["rank"]) for r in db.query_on("profiles").get().result_array()) == [(1, 77), (2, 30), (3, 20), (9, 10)]
    db.query("INSERT INTO profiles VALUES (10, 1, 5)")
    assert db.affected_rows == 1 and db.count_all("profiles") == 5
    db.query("UPDATE profiles SET rank = rank + 1 WHERE id > 3")
    assert db.affected_rows == 2
    db.query("DELETE FROM profiles WHERE id = 10 OR id = 9")
    assert db.affected_rows == 2 and db.update_batch("profiles", [{"id": 1, "rank": 1}, {"id": 50, "rank": 2}], "id") == 1
    db.empty_table("profiles")
    assert db.affected_rows == 3


@pytest.mark.parametrize("negated", [False, True])
def test_long_lists_behave_as_short_ones(spark, negated, monkeypatch):
    from relquery.plans import compiler

    frame = spark.createDataFrame([(1, 1.5, "1", True), (2, 2.0, "x", False), (None, None, None, None)], "i int, d double, s string, b boolean")
    lists = [[1.5, 1], ["1", "zz"], [1, "2", None], [True, 2], [None], ["true", 1], [2.0, "x", True]]
    for column in ("i", "d", "s", "b"):
        for values in lists:
            found = []
            for limit in (10_000, 0):
                monkeypatch.setattr(compiler, "LONG_LIST", limit)
                q = Session(spark, {"t": frame}).query_on("t")
                found.append(sorted(map(str, (q.where_not_in if negated else q.where_in)(column, values).get().result_array())))
            assert found[0] == found[1], (column, values, found)


def test_committed_tables_last(spark, tmp_path, db):
    folder = str(tmp_path / "store")
    one = Session(spark, {"people": db.table("people")}, store=folder)
    one.insert("people", {"id": 4, "name": "Dora"})
    assert Session(spark, store=folder).count_all("people") == 4
    one.trans_begin()
    one.delete("people", {"id": 4})
    one.add_field("id")
    one.create_table("made")
    assert Session(spark, store=folder).list_tables() == ["people"] and one.count_all("people") == 3
    one.trans_rollback()
    assert one.count_all("people") == 4 and not one.table_exists("made")
    before = sorted(str(p) for p in (tmp_path / "store").rglob("*"))
    assert one.transaction(lambda s: (s.delete("people", {"id": 4}), 1 / 0)) is False and sorted(str(p) for p in (tmp_path / "store").rglob("*")) == before
    for k in range(12):
        one.update("people", {"name": f"n{k}"}, {"id": 1})
    assert one.table("people")._jdf.queryExecution().analyzed().toString().count("\n") < 4
    two = Session(spark, store=folder)
    assert two.query_on("people").where("id", 1).value("name") == "n11"
    two.rename_table("people", "folk")
    assert Session(spark, store=folder).list_tables() == ["folk"]
    from relquery.sources.store import Conflict

    with pytest.raises(Conflict):
        one.update("people", {"name": "late"}, {"id": 1})
    assert two.tables.store.sweep() > 5 and Session(spark, store=folder).count_all("folk") == 4


def test_pages_by_key_read_the_table_once(spark):
    frame = spark.createDataFrame([(k // 2, k) for k in range(20)] + [(None, 99)], "id int, n int").repartition(3)
    pages = []
    assert Session(spark, {"t": frame}).query_on("t").chunk_by_id(3, lambda p: pages.append([r.id for r in p])) == 17
    assert pages == [[None, 0, 0], [1, 1, 2], [3, 3, 4], [5, 5, 6], [7, 7, 8], [9, 9]]


def test_names_in_text_are_not_tables(db):
    assert db.query("SELECT 'profiles' AS x").value("x") == "profiles" and not db.spark.catalog.tableExists("category_scores")
    assert db.protect_identifiers("people.id AS x") == "`people`.`id` AS `x`" and db.protect_identifiers("people.*") == "`people`.*" and db.protect_identifiers("count(x)") == "count(x)"
    db.set_dbprefix("pre_")
    assert db.protect_identifiers("people.id") == "`pre_people`.`id`"
    db.set_dbprefix("")
    db.query_on("people").calc_rows().get(limit=1)
    assert db.get_found_rows() == 3
    from relquery.sources.tables import sql_text

    assert sql_text(db.tables, ["profiles"]).splitlines()[:2] == ["DROP TABLE IF EXISTS profiles;", "CREATE TABLE profiles (id BIGINT, person_id BIGINT, rank BIGINT);"]
