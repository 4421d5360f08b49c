import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import semantics as S
from sparrowmill.operators import relational as R
from sparrowmill.plans.engine import Conflict, Database, split_top
from sparrowmill.sources import files
from sparrowmill.streaming import events

LEFT = [(1, "a"), (2, "b"), (2, "c"), (None, "d")]
RIGHT = [(2, 10), (3, 20), (None, 30)]
OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def brute(left, right, op, mode):
    """The join by comparing all rows, with unknown comparisons."""
    hit = lambda a, b: None if a is None or b is None else OPS[op](a, b)
    if mode == "semi":
        return [x for x in left if any(hit(x[0], y[0]) for y in right)]
    if mode == "anti_null_as_false":
        return [x for x in left if not any(hit(x[0], y[0]) for y in right)]
    if mode == "anti_null_as_true":
        return [x for x in left if all(hit(x[0], y[0]) is False for y in right)]
    out = [(*x, *y) for x in left for y in right if hit(x[0], y[0])]
    if mode in ("left", "full"):
        out += [(*x, None, None) for x in left if not any(hit(x[0], y[0]) for y in right)]
    if mode in ("right", "full"):
        out += [(None, None, *y) for y in right if not any(hit(x[0], y[0]) for x in left)]
    return out


@pytest.mark.parametrize("mode", [m for m in R.MODES if m != "cross"])
@pytest.mark.parametrize("op", list(OPS))
@pytest.mark.parametrize("n", [0, 3])
def test_joins_against_brute_force(spark, mode, op, n):
    left, right = spark.createDataFrame(LEFT, "k int, v string"), spark.createDataFrame(RIGHT[:n], "j int, w int")
    got = [tuple(r) for r in R.join(left, right, [("k", op, "j")], mode).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(LEFT, RIGHT[:n], op, mode)))


def test_scalar_semantics(spark):
    df = spark.createDataFrame([(22, 5, "HELLO"), (-5, 3, "a_b"), (7, 0, None)], "a int, b int, s string")
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    got = df.select(S.int_div(a, b), S.safe_mod(a, b), S.safe_div(a, b), S.substr(s, 0, 2), S.substr(s, -2, 2), S.like(s, "a\\_b").cast("int"), S.cast_to_int(a + 0.7)).collect()
    assert [tuple(r) for r in got] == [(4, 2, 4.4, "H", "LO", 0, 22), (-1, -2, -5 / 3, "a", "_b", 0, -4), (None, None, None, None, None, None, 7)]
    assert S.common_type(files.TYPES["int"], files.TYPES["float"]) == files.TYPES["float"]
    with pytest.raises(TypeError):
        S.common_type(files.TYPES["int"], files.TYPES["string"])


def test_aggregates_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (None, 3.0)], "k int, v double")
    got = R.aggregate(df, ["k"], [("sum", "v", "s"), ("count", "v", "n"), ("count", None, "all"), ("stddev_samp", "v", "sd")])
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2.0, 1, 2, None), (None, 3.0, 1, 1, None)]
    empty = R.aggregate(df.where("k > 5"), [], [("sum", "v", "s"), ("count", None, "n")])
    assert tuple(empty.first()) == (None, 0)
    with pytest.raises(TypeError):
        R.aggregate(spark.createDataFrame([("a",)], "x string"), [], [("sum", "x", "s")])


def test_sort_puts_nulls_first(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in R.sort(df, ["x"]).collect()] == [None, 1, 2]
    assert [r[0] for r in R.sort(df, ["x"], ["x"]).collect()] == [None, 2, 1]


def test_stable_sort_keeps_the_order_of_equal_keys(spark):
    df = spark.createDataFrame([(i * 7 % 3, 99 - i) for i in range(60)], "k int, v int").repartition(1).sortWithinPartitions(F.col("v").desc())
    got = [tuple(r) for r in R.sort(df, ["k"], stable=True).collect()]
    assert got == sorted([tuple(r) for r in df.collect()], key=lambda r: r[0])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("a|b|s\nint|float_null|string\n1|2.5|x\n2|null|y z\n")
    df = files.read_tbl(spark, str(tmp_path / "t.tbl"))
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, "x"), (2, None, "y z")]
    odd = spark.createDataFrame([(1, 'quo"te'), (2, "com,ma"), (3, ""), (None, None)], "a int, s string")
    files.write_csv(odd, str(tmp_path / "o.csv"))
    back = files.read_csv(spark, str(tmp_path / "o.csv"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, odd.collect())))
    files.write_file(odd, str(tmp_path / "o.bin"))
    assert files.read_file(spark, str(tmp_path / "o.bin")).count() == 4
    with pytest.raises(ValueError):
        files.file_type("x.xls")


def test_statements(spark, tmp_path):
    db = Database(spark)
    s = db.session()
    s.run("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10)); INSERT INTO t VALUES (1, 'x'); INSERT INTO t (a) VALUES (2); INSERT INTO t SELECT a + 10, b FROM t")
    assert sorted(r[0] for r in s.run("SELECT a FROM t").collect()) == [1, 2, 11, 12]
    s.run("DELETE FROM t WHERE b = 'x'; UPDATE t SET b = 'n' WHERE a > 10")
    assert sorted(map(tuple, s.run("SELECT * FROM t").collect()), key=repr) == [(12, "n"), (2, None)]
    s.run("CREATE VIEW v AS SELECT a FROM t; DROP VIEW v; DROP TABLE IF EXISTS u; CREATE TABLE IF NOT EXISTS t (z INT)")
    assert {r["column_name"] for r in s.run("SHOW COLUMNS t").collect()} == {"a", "b"}
    assert s.run("SHOW TABLES").first()["row_count"] == 2
    s.run(f"COPY t TO '{tmp_path}/t.csv'; COPY w FROM '{tmp_path}/t.csv'")
    assert s.table("w").count() == 2
    assert split_top("a, 'b,c', (d, e)", ",") == ["a", "'b,c'", "(d, e)"]
    with pytest.raises(ValueError):
        s.run("ALTER TABLE t")


def test_transactions(spark):
    db = Database(spark)
    db.add("t", spark.createDataFrame([(1,)], "a int"))
    one, two = db.session(), db.session()
    one.begin()
    one.run("INSERT INTO t VALUES (2)")
    assert (one.table("t").count(), two.table("t").count()) == (2, 1)
    two.run("DELETE FROM t WHERE a = 1")
    with pytest.raises(Conflict):
        one.commit()
    one.begin()
    one.run("INSERT INTO t VALUES (5)")
    one.rollback()
    assert db.tables["t"].count() == 0


def test_meta_tables_and_plugins(spark):
    db, ran = Database(spark), []
    db.plugins["p"] = {"go": lambda: ran.append(1)}
    db.settings["verbose"] = ("0", "how much to say")
    s = db.session()
    s.run("INSERT INTO meta_plugins VALUES ('p'); INSERT INTO meta_exec VALUES ('p', 'go'); UPDATE meta_settings SET value = '1' WHERE name = 'verbose'")
    assert ran and db.settings["verbose"][0] == "1"
    assert s.run("SELECT * FROM meta_exec").count() == 1
    db.add("t", spark.range(3).toDF("a"))
    for name in ("tables", "columns", "chunks", "segments", "chunk_sort_orders", "log", "system_information", "system_utilization"):
        assert s.run(f"SELECT * FROM meta_{name}").columns
    s.run("DELETE FROM meta_plugins WHERE name = 'p'")
    assert s.run("SELECT * FROM meta_plugins").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "events.parquet")).schema).parquet(str(tmp_path / "events.parquet"))
    query = events.tumbling(source).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    query.processAllAvailable()
    query.stop()
    batch = events.tumbling(spark.read.parquet(str(tmp_path / "events.parquet")))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_tables_may_hold_rows_like_their_header(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.tbl").write_text("a|b\nstring|string\nstring|string\na|b\nx|null\nstring|string\n")
    one = [tuple(r) for r in files.read_tbl(spark, str(tmp_path / "1.tbl")).collect()]
    assert sorted(one, key=repr) == sorted([("string", "string"), ("a", "b"), ("x", None), ("string", "string")], key=repr)
    assert files.read_tbl(spark, str(tmp_path)).count() == 8


def test_csv_refuses_carriage_returns(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'1,"x"\r\n2,"y"\r\n')
    about = {"columns": [{"name": "a", "type": "int"}, {"name": "s", "type": "string"}]}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c.csv"), about)


@pytest.mark.parametrize("ops", [[("k", "=", "j"), ("k", "<", "w")], [("k", "<", "j")]])
def test_null_as_true_of_several_conditions(spark, ops):
    left, right = spark.createDataFrame(LEFT, "k int, v string"), spark.createDataFrame(RIGHT, "j int, w int")
    unknown = lambda xs: False if False in xs else None if None in xs else True
    want = [x for x in LEFT if all(unknown([None if x[0] is None or y["jw".index(c)] is None else OPS[op](x[0], y["jw".index(c)]) for _, op, c in ops]) is False for y in RIGHT)]
    assert sorted(map(repr, map(tuple, R.join(left, right, ops, "anti_null_as_true").collect()))) == sorted(map(repr, want))
    plan = R.join(left, right, [("k", "=", "j")], "anti_null_as_true")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
