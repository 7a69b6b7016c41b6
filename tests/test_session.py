"""Statements of a session: tables and their changes, views, variables, prepared statements, functions, sources."""

import pytest
from pyspark.sql import functions as F

from millrace import sources, streaming
from millrace.operators.dml import ConstraintError
from millrace.session import Session


@pytest.fixture()
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}")


def all_rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def test_table_changes(s):
    s.sql("CREATE TABLE t1 (id INT NOT NULL PRIMARY KEY, val INT, name VARCHAR(20))")
    s.sql("INSERT INTO t1 VALUES (1, 10, 'a'), (2, 20, 'b')")
    s.sql("INSERT INTO t1 (id, name) VALUES (3, 'c')")
    assert all_rows(s, "SELECT * FROM t1 ORDER BY id") == [(1, 10, "a"), (2, 20, "b"), (3, None, "c")]
    s.sql("INSERT IGNORE INTO t1 VALUES (1, 99, 'z'), (4, 40, 'd')")
    s.sql("INSERT INTO t1 VALUES (2, 5, 'q'), (5, 50, 'e') ON DUPLICATE KEY UPDATE val = val + VALUES(val), name = 'up'")
    s.sql("REPLACE INTO t1 VALUES (3, 33, 'r')")
    assert all_rows(s, "SELECT * FROM t1 ORDER BY id") == [(1, 10, "a"), (2, 25, "up"), (3, 33, "r"), (4, 40, "d"), (5, 50, "e")]
    s.sql("UPDATE t1 SET val = val * 2, name = CONCAT(name, '!') WHERE id > 3")
    s.sql("DELETE FROM t1 WHERE val = 10 OR name = 'r'")
    assert all_rows(s, "SELECT * FROM t1 ORDER BY id") == [(2, 25, "up"), (4, 80, "d!"), (5, 100, "e!")]
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO t1 VALUES (2, 1, 'x')")
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO t1 VALUES (NULL, 1, 'x')")
    s.sql("ALTER TABLE t1 ADD COLUMN extra BIGINT DEFAULT 7 AFTER id")
    s.sql("ALTER TABLE t1 CHANGE name label VARCHAR(30)")
    s.sql("ALTER TABLE t1 DROP COLUMN val")
    assert all_rows(s, "SELECT * FROM t1 WHERE id = 2") == [(2, 7, "up")]
    s.sql("TRUNCATE TABLE t1")
    assert all_rows(s, "SELECT COUNT(*) FROM t1") == [(0,)]
    s.sql("DROP TABLE t1")


def test_auto_increment_and_create_as(s):
    s.sql("CREATE TABLE a (id BIGINT AUTO_INCREMENT PRIMARY KEY, x INT)")
    s.sql("INSERT INTO a (x) VALUES (5), (6)")
    s.sql("INSERT INTO a VALUES (0, 7)")
    assert sorted(all_rows(s, "SELECT id, x FROM a")) == [(1, 5), (2, 6), (3, 7)]
    s.sql("CREATE TABLE b AS SELECT x, COUNT(*) AS n FROM a GROUP BY x")
    s.sql("INSERT INTO b SELECT x + 100, id FROM a WHERE id < 2")
    assert sorted(all_rows(s, "SELECT * FROM b")) == [(5, 1), (6, 1), (7, 1), (105, 1)]


def test_views_variables_prepared_functions(s, spark):
    spark.range(10).withColumnRenamed("id", "a").createOrReplaceTempView("n")
    s.sql("CREATE VIEW big AS SELECT a FROM n WHERE a > 6")
    assert sorted(all_rows(s, "SELECT a FROM big")) == [(7,), (8,), (9,)]
    s.sql("SET @m = (SELECT MAX(a) FROM big)")
    assert all_rows(s, "SELECT @m + 1 AS x, @none AS y") == [(10, None)]
    s.sql("PREPARE p FROM 'SELECT a FROM n WHERE a = ? OR a = ? ORDER BY a'")
    s.sql("SET @q = 3")
    assert all_rows(s, "EXECUTE p USING @q, @m") == [(3,), (9,)]
    s.sql("DEALLOCATE PREPARE p")
    s.sql("CREATE FUNCTION twice(x BIGINT) RETURNS BIGINT RETURN x * 2")
    assert all_rows(s, "SELECT twice(21) AS v") == [(42,)]
    assert all_rows(s, "DESCRIBE big")[0][1] == "a"
    assert "Filter" in all_rows(s, "EXPLAIN SELECT a FROM n WHERE a > 3")[0][0]
    s.sql("DROP VIEW big")


def test_load_data(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("one\ntwo\\\nmore\nthree\n")
    assert [r.line for r in sources.load_data(spark, str(p)).collect()] == ["one", "two\nmore", "three"]


def test_windows_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 05:00:00", "b")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streaming.tumbling(stream, "ts", "1 hour", ["k"], F.count(F.lit(1)).alias("n"))
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_plans(spark, sf):
    """Filters and columns reach the scan; nothing runs Python."""
    from millrace.queries import QUERIES

    plan = QUERIES["scan_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
    for name in ("flagship", "pricing_summary", "date_fields", "string_cut", "json_read"):
        assert "Python" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_procedures(s, spark):
    spark.range(1, 6).createOrReplaceTempView("five")
    s.sql("""CREATE PROCEDURE fact(IN n INT, OUT r BIGINT)
    BEGIN
      DECLARE i INT DEFAULT 1;
      SET r = 1;
      WHILE i <= n DO
        SET r = r * i;
        SET i = i + 1;
      END WHILE;
    END""")
    s.sql("CALL fact(5, @f)")
    assert s.variables["f"] == 120
    s.sql("""CREATE PROCEDURE total(OUT t BIGINT, OUT word VARCHAR(9))
    BEGIN
      DECLARE done INT DEFAULT 0;
      DECLARE x BIGINT;
      DECLARE c CURSOR FOR SELECT id FROM five ORDER BY id;
      DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
      SET t = 0;
      OPEN c;
      walk: LOOP
        FETCH c INTO x;
        IF done = 1 THEN LEAVE walk; END IF;
        IF x = 2 THEN ITERATE walk; END IF;
        SET t = t + x;
      END LOOP walk;
      CLOSE c;
      CASE WHEN t > 10 THEN SET word = 'big'; ELSE SET word = 'small'; END CASE;
      CALL fact(3, @g);
      SELECT COUNT(*) INTO x FROM five WHERE id > @g - 3;
      SELECT x AS n, t AS total;
    END""")
    assert [tuple(r) for r in s.sql("CALL total(@t, @w)").collect()] == [(2, 13)]
    assert (s.variables["t"], s.variables["w"]) == (13, "big")


def test_triggers(s):
    s.sql("CREATE TABLE log (what VARCHAR(9), id INT)")
    s.sql("CREATE TABLE p (id INT PRIMARY KEY, price INT)")
    s.sql("CREATE TRIGGER b BEFORE INSERT ON p FOR EACH ROW SET NEW.price = IF(NEW.price < 0, 0, NEW.price)")
    s.sql("CREATE TRIGGER a AFTER INSERT ON p FOR EACH ROW INSERT INTO log VALUES ('new', NEW.id)")
    s.sql("CREATE TRIGGER d AFTER DELETE ON p FOR EACH ROW INSERT INTO log VALUES ('gone', OLD.id)")
    s.sql("INSERT INTO p VALUES (1, -5), (2, 7)")
    s.sql("DELETE FROM p WHERE id = 2")
    assert all_rows(s, "SELECT * FROM p") == [(1, 0)]
    assert sorted(all_rows(s, "SELECT * FROM log")) == [("gone", 2), ("new", 1), ("new", 2)]


def test_session_functions(s):
    s.sql("CREATE TABLE q (id BIGINT AUTO_INCREMENT PRIMARY KEY, x INT)")
    s.sql("INSERT INTO q (x) VALUES (5), (6)")
    assert all_rows(s, "SELECT LAST_INSERT_ID(), ROW_COUNT(), DATABASE(), VERSION() LIKE '8%', CONNECTION_ID()") == [(1, 2, "default", True, 1)]
    assert all_rows(s, "SELECT GET_LOCK('a', 1), IS_FREE_LOCK('a'), RELEASE_LOCK('a'), RELEASE_LOCK('a'), IS_FREE_LOCK('a')") == [(1, 0, 1, None, 1)]


def test_load_data_joins_continued_lines(spark, tmp_path):
    from millrace import sources

    (tmp_path / "lines.txt").write_text("a\nb\\\nc\\\nd\ne\n")
    assert sorted(r[0] for r in sources.load_data(spark, f"file://{tmp_path}/lines.txt").collect()) == ["a", "b\nc\nd", "e"]
