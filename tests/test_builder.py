"""Built queries have the trees and the results of written ones."""

import pytest

from colsql.builder import Builder, bm25, case, exists, fn, match, ref
from colsql.plans.parser import parse


@pytest.fixture(scope="module")
def b(tpch):
    return Builder(tpch)


def same(built, written, params=()):
    """The same tree, the same parameters."""
    c = built.compile()
    assert c.tree() == parse(written)[0] and c.params == list(params)


def test_trees_are_those_of_the_parser(b):
    same(b.select_from("nation").select("n_name").where(ref("n_regionkey") == 1, ref("n_name").like("A%")), 'SELECT "n_name" FROM "nation" WHERE ("n_regionkey" = ?) AND ("n_name" LIKE ?)', [1, "A%"])
    same(
        b.select_from("nation", "n").left_join("region", ref("n.n_regionkey") == ref("r.r_regionkey"), "r").select("r.r_name", fn.count_all().as_("n")).group_by("r.r_name").having(fn.count_all() > 2).order_by(("n", "desc", "last"), "r.r_name").limit(3).offset(1),
        "SELECT r.r_name, COUNT(*) AS n FROM nation AS n LEFT JOIN region AS r ON (n.n_regionkey = r.r_regionkey) GROUP BY r.r_name HAVING (COUNT(*) > ?) ORDER BY n DESC NULLS LAST, r.r_name LIMIT ? OFFSET ?",
        [2, 3, 1],
    )
    same(b.select_from("nation").select_all().distinct().union_all(b.select_from("nation").select_all().where(~ref("n_name").is_null())), "SELECT DISTINCT * FROM nation UNION ALL SELECT * FROM nation WHERE (NOT (n_name IS NULL))")
    inner = b.select_from("region").select("r_regionkey").where(ref("r_name") == "ASIA")
    same(b.select_from("nation").select("n_name").where(ref("n_regionkey").in_(inner) | ref("n_nationkey").in_([1, 2])), "SELECT n_name FROM nation WHERE ((n_regionkey IN (SELECT r_regionkey FROM region WHERE (r_name = ?))) OR (n_nationkey IN (?, ?)))", ["ASIA", 1, 2])
    same(b.with_("x", inner).select_from("x").select_all(), "WITH x AS (SELECT r_regionkey FROM region WHERE (r_name = ?)) SELECT * FROM x", ["ASIA"])
    same(b.select_from("documents").select("doc_id", bm25(["text"], "the er*").as_("s")).where(match(["text"], "the")), "SELECT doc_id, BM25(text) AGAINST ? AS s FROM documents WHERE MATCH(text) AGAINST ?", ["the er*", "the"])
    same(b.select_from("nation").select(fn.row_number().over(["n_regionkey"], [("n_name", "desc")]).as_("k")), "SELECT ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS k FROM nation")
    same(b.select_from("nation").select(case((ref("n_nationkey") < 5, "low"), otherwise="high").as_("c")), "SELECT (CASE WHEN (n_nationkey < ?) THEN ? ELSE ? END) AS c FROM nation", [5, "low", "high"])
    same(b.update_table("t").set(a=1, b=ref("b") + 2).where(ref("id").between(1, 3)).returning("id"), "UPDATE t SET a = ?, b = (b + ?) WHERE (id BETWEEN ? AND ?) RETURNING id", [1, 2, 1, 3])
    same(b.insert_into("t").values({"id": 1, "a": None}, {"id": 2, "b": "x"}).on_conflict("id", "a"), "INSERT INTO t (id, a, b) VALUES (?, ?, ?), (?, ?, ?) ON CONFLICT (id) DO UPDATE SET a = EXCLUDED.a", [1, None, None, 2, None, "x"])
    same(b.delete_from("t").where(exists(inner)).returning_all(), "DELETE FROM t WHERE EXISTS (SELECT r_regionkey FROM region WHERE (r_name = ?)) RETURNING *", ["ASIA"])


def test_results(b):
    q = b.select_from("nation", "n").join("region", ref("n.n_regionkey") == ref("r.r_regionkey"), "r").where(ref("r.r_name") != "ASIA").group_by("r.r_name").select("r.r_name", fn.max("n.n_nationkey").as_("top"))
    rows = q.order_by(("top", "desc")).execute()
    assert [tuple(r) for r in rows] == [tuple(r) for r in b.session.sql("SELECT r.r_name, MAX(n_nationkey) AS top FROM nation JOIN region r ON n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA' GROUP BY r.r_name ORDER BY top DESC").collect()]
    assert q.order_by("top").take_first() is not None and b.select_from("nation").select_all().where(ref("n_nationkey") < 0).take_first() is None
    with pytest.raises(LookupError):
        b.select_from("nation").select_all().where(ref("n_nationkey") < 0).take_first_or_raise()
    top = b.select_from("orders").select(fn.max("o_totalprice").as_("m"))
    assert b.select_from("orders").select("o_orderkey").where(ref("o_totalprice") == top).frame().count() == 1


def test_changes_live_and_transactions(db):
    b = Builder(db)
    b.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    assert b.insert_into("t").values({"id": 1, "v": "a"}, {"id": 2, "v": "it's"}).execute().count == 2
    seen = []
    live = b.select_from("t").select("v").where(ref("id") == 2).live(on_change=lambda df: seen.append([r.v for r in df.collect()]))
    assert [r.id for r in b.update_table("t").set(v="new").where(ref("id") == 2).returning("id").execute().rows.collect()] == [2.0]
    live.poll()
    assert seen == [["it's"], ["new"]]
    assert b.insert_into("t").select(["id", "v"], b.select_from("t").select((ref("id") + 10).as_("i"), "v")).execute().count == 2
    assert b.insert_into("t").values({"id": 1, "v": "z"}).on_conflict("id").execute().count == 0

    def body(tx):
        tx.delete_from("t").where(ref("id") > 10).execute()
        tx.update_table("t").set(v=ref("v").concat("!")).execute()

    b.transaction(body)
    assert sorted(tuple(r) for r in b.select_from("t").select("id", "v").execute()) == [(1.0, "a!"), (2.0, "new!")]
    assert [r.v for r in b.sql("SELECT v FROM t WHERE id = ", 1, " OR v = ", "none").rows.collect()] == ["a!"]
