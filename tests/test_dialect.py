"""Statements of the engine's dialect through Session.run, held against what they mean."""

import sqlite3

import pytest

from sparrowmill.plans import dialect
from sparrowmill.plans.engine import Database

T_ROWS = [(1, 10, 2.5, "x"), (2, 0, -1.25, "a_b"), (3, None, None, None), (4, 7, 0.5, "HELLO"), (5, -7, 4.0, "a\\_b"), (6, 10, 2.5, "it's")]
U_ROWS = [(10, "p"), (7, "q"), (None, "r"), (0, None), (10, "s")]


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.createDataFrame(T_ROWS, "id int, b int, c double, d string").cache(), "u": spark.createDataFrame(U_ROWS, "b int, e string").cache()}


@pytest.fixture
def session(spark, tables):
    db = Database(spark)
    for name, df in tables.items():
        db.add(name, df)
    return db.session()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 22 / 5, 7 / 2 / 2, -7 / 2, 1 / 0, 5 % 0, 7.0 / 2", [(4, 1, -3, None, None, 3.5)]),
        ("SELECT id FROM t WHERE 100 / b > 12", [(4,)]),
        ("SELECT 10 / (1 + 1) * 2 + 8 / 3", [(12,)]),
        ("SELECT substr('HELLO', 0, 2), substr('HELLO', -4, 3), substr('HELLO', 2, 3), substr('HELLO', 1 - 1, 3)", [("H", "ELL", "ELL", "HE")]),
        (r"SELECT 'a_b' LIKE 'a\_b', 'a\_b' LIKE 'a\_b', 'a\xb' LIKE 'a\_b', 'ab' NOT LIKE 'a%'", [(0, 1, 1, 0)]),
        (r"SELECT d FROM t WHERE d LIKE 'a\_b'", [("a\\_b",)]),
        (r"SELECT '\n'", [("\\n",)]),
        ("SELECT 'a--b', 'c;d', 'it''s' -- a comment; and more", [("a--b", "c;d", "it's")]),
        ("SELECT b FROM t ORDER BY b DESC, id", [(None,), (10,), (10,), (7,), (0,), (-7,)]),
        ("SELECT b FROM t ORDER BY b, id", [(None,), (-7,), (0,), (7,), (10,), (10,)]),
        ("SELECT 3 > 2, 3 < 2, NULL > 1, NOT 3 > 2", [(1, 0, None, 0)]),
        ("SELECT 5 IN (6, '5'), 5 IN (5, 'x'), 'x' IN ('x', 9, 13 * 13), 5 NOT IN ('5', 7)", [(0, 1, 1, 1)]),
        ("SELECT id FROM t WHERE d IN ('x', 9, 'HELLO') ORDER BY id", [(1,), (4,)]),
        ("SELECT id, count(DISTINCT b) OVER (PARTITION BY c) AS n FROM t WHERE c > 1 ORDER BY id", [(1, 1), (5, 1), (6, 1)]),
        ("SELECT id + 5 AS n FROM t WHERE n > 9 ORDER BY n", [(10,), (11,)]),
        ("SELECT b AS x FROM t WHERE id < (SELECT max(b) FROM u WHERE u.b >= x) ORDER BY id", [(10,), (0,), (7,), (-7,), (10,)]),
        ('SELECT "q"."b" AS "the b" FROM u AS "q" WHERE "q".e = \'p\'', [(10,)]),
        ("SELECT id FROM t WHERE 1 OR b > 2 ORDER BY id LIMIT 2", [(1,), (2,)]),
        ("SELECT DISTINCT id + 1, b FROM t WHERE b > 5 ORDER BY id + 1 DESC", [(7, 10), (5, 7), (2, 10)]),
        ("SELECT b / 3, count(*) FROM t GROUP BY b / 3 ORDER BY b / 3", [(None, 1), (-2, 1), (0, 1), (2, 1), (3, 2)]),
        ("SELECT CASE WHEN b / 4 = 2 THEN 'two' ELSE 'other' END FROM t WHERE id < 3 ORDER BY id", [("two",), ("other",)]),
        ("SELECT * FROM (SELECT id, b / 4 AS q FROM t) AS s WHERE q = 2 ORDER BY id", [(1, 2), (6, 2)]),
        ("WITH s AS (SELECT b / 4 AS q FROM t) SELECT sum(q), avg(q / 2) FROM s", [(4, 0.4)]),
        ("SELECT t.id, u.e FROM t JOIN u ON t.b / 2 = u.b / 2 WHERE t.id = 4", [(4, "q")]),
        ("SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.b / 5 = t.b / 5 AND u.e = 'p') ORDER BY id", [(1,), (6,)]),
        ("SELECT coalesce(b, -1) + .5, 1e2 FROM t WHERE id = 3", [(-0.5, 100.0)]),
        ("SELECT id FROM t WHERE b BETWEEN 1 AND 50 / 5 ORDER BY id", [(1,), (4,), (6,)]),
        ("SELECT date '2000-01-31' + interval '1' month = date '2000-02-29'", [(1,)]),
        ("SELECT max(b) AS m FROM t GROUP BY id HAVING m > 7", [(10,), (10,)]),
        ("SELECT (SELECT max(b) + t.id FROM u) AS m FROM t WHERE id < 3 ORDER BY id", [(11,), (12,)]),
        ("SELECT id FROM t AS r WHERE id + 1 = (SELECT min(b) + r.id + 1 FROM u) ORDER BY id LIMIT 1", [(1,)]),
        ("SELECT id FROM t WHERE id < 2 UNION ALL SELECT NULL ORDER BY id", [(None,), (1,)]),
    ],
)
def test_meaning(session, text, want):
    assert rows(session.run(text)) == want


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT b + b, b * c - 1 FROM t", "SELECT t.*, e FROM t JOIN u ON t.b = u.b", "SELECT b, t.c FROM t GROUP BY b, t.c", "SELECT * FROM u GROUP BY b, e",
        "SELECT count(*), count(b), count(DISTINCT b), sum(b), min(c), max(d) FROM t", "SELECT count(*) + 1 FROM t WHERE b IS NULL", "SELECT b, sum(c) FROM t GROUP BY b HAVING sum(c) > 1 OR b = 0",
        "SELECT id FROM t WHERE b NOT IN (SELECT b FROM u WHERE b IS NOT NULL)", "SELECT id FROM t WHERE b NOT IN (SELECT b FROM u)", "SELECT id FROM t LEFT JOIN u ON t.b = u.b AND u.e <> 'p'",
        "SELECT a.id, c.id FROM t AS a, t AS c WHERE a.b = c.b AND a.id <> c.id", "SELECT id, (SELECT max(u.b) FROM u WHERE u.b < t.b) FROM t", "SELECT 2 / 0, b / 0, 50 / id, 50 % id FROM t",
        "SELECT (b * c) / id + (c * c) / id - id / id FROM t", "SELECT b FROM t UNION SELECT b FROM u", "SELECT b FROM t UNION ALL SELECT b FROM u", "SELECT b FROM t EXCEPT SELECT b FROM u", "SELECT b FROM t INTERSECT SELECT b FROM u",
        "SELECT CASE b WHEN 10 THEN 'ten' WHEN 0 THEN 'none' END FROM t", "SELECT CAST(c AS INT), CAST(id AS TEXT) FROM t WHERE c IS NOT NULL", "SELECT id FROM t WHERE NOT (b IN (7, 10))",
        "SELECT sum(DISTINCT b), avg(DISTINCT b) FROM t", "SELECT sum(m) FROM (SELECT max(b) AS m FROM t GROUP BY c) AS s", "SELECT id FROM t NATURAL JOIN (SELECT 2 AS id) AS o", "SELECT id FROM t INNER JOIN (SELECT 4 AS id) AS o USING (id)",
    ],
)
def test_equals_sqlite(session, text):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (id INT, b INT, c REAL, d TEXT)")
    con.execute("CREATE TABLE u (b INT, e TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", T_ROWS)
    con.executemany("INSERT INTO u VALUES (?, ?)", U_ROWS)
    assert sorted(map(repr, rows(session.run(text)))) == sorted(map(repr, con.execute(text).fetchall()))


def test_types_and_names(session):
    ranks = session.run("SELECT rank() OVER (ORDER BY b DESC) AS r, row_number() OVER (PARTITION BY c ORDER BY id) + 1 AS n FROM t")
    assert [f.dataType.simpleString() for f in ranks.schema.fields] == ["bigint", "bigint"] and ranks.agg({"r": "max"}).first()[0] == 6
    out = session.run("SELECT id / 2, c / 2, id > 1, b + 1 AS n, count(*) OVER () FROM t")
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["int", "double", "int", "int", "bigint"]
    assert out.columns == ["id / 2", "c / 2", "id > 1", "n", "count(*) OVER ()"]
    for text in ("SELECT sum(d) FROM t", "SELECT avg(d) FROM t GROUP BY id", "SELECT id FROM t UNION ALL SELECT d FROM t", "SELECT b FROM t EXCEPT SELECT c FROM t ORDER BY b"):
        with pytest.raises(TypeError):
            session.run(text)


def test_statements_are_split_outside_quotes():
    assert dialect.statements("SELECT ';' ; -- no; end\n SELECT \"a;b\" /* x; */; ;") == ["SELECT ';'", 'SELECT "a;b"']


def test_views_follow_their_tables(session):
    session.run("CREATE VIEW v (n, m) AS SELECT count(*), max(id) / 4 FROM t; CREATE VIEW w AS SELECT n + 1 AS k FROM v")
    assert rows(session.run("SELECT * FROM v")) == [(6, 1)] and rows(session.run("SELECT k FROM w")) == [(7,)]
    session.run("INSERT INTO t VALUES (9, 1, 1.0, 'n')")
    assert rows(session.run("SELECT * FROM v")) == [(7, 2)] and rows(session.run("SELECT k FROM w")) == [(8,)]
    with pytest.raises(ValueError):
        session.run("CREATE VIEW v AS SELECT 1")


def test_changes_are_stored(spark, tables, tmp_path):
    db = Database(spark, str(tmp_path))
    db.add("t", tables["t"])
    s = db.session()
    s.run("UPDATE t SET b = b / 2, c = id WHERE id < 3; DELETE FROM t WHERE id > 4; INSERT INTO t SELECT id + 10, b, c, d FROM t WHERE b / 2 = 2")
    assert sorted(rows(s.run("SELECT id, b, c FROM t")), key=repr) == sorted([(1, 5, 1.0), (2, 0, 2.0), (3, None, None), (4, 7, 0.5), (11, 5, 1.0)], key=repr)
    assert len(list(tmp_path.iterdir())) == 3
    with pytest.raises(ValueError):
        s.run("INSERT INTO t VALUES (1, 2)")


def test_prepared_statements_divide(session):
    session.run("PREPARE p FROM 'SELECT id / ? AS x FROM t WHERE d = ? OR id % ? = 0 ORDER BY id'")
    assert rows(session.run("EXECUTE p (2, 'x', 3)")) == [(0,), (1,), (3,)]
