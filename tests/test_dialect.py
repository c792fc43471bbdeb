"""The same statements on the engine and on the sqlite3 module: results and failures must agree."""

import sqlite3

import pytest
from larkspur.api import Database
from larkspur.errors import SqlError

SCRIPT = """
CREATE TABLE t(id INTEGER PRIMARY KEY, g TEXT, v INTEGER);
INSERT INTO t(g,v) VALUES ('a',1),('a',2),('a',NULL),('b',5),('b',5),('A ',7);
CREATE TABLE users(id INTEGER PRIMARY KEY, name TEXT);
CREATE TABLE orders(id INTEGER PRIMARY KEY, user_id INTEGER, total REAL);
INSERT INTO users VALUES (1,'Ada'),(2,'Bob'),(3,'Cy');
INSERT INTO orders VALUES (10,1,20),(11,1,30.5),(12,2,5);
"""

QUERIES = r"""
SELECT 1+1, 7/2, 7%3, -7/2, 7.0/2, 1/0, 'a'||1||2.5, '5'+1, 5 & 3, 1<<4, ~5
SELECT g COLLATE NOCASE AS k, count(*) FROM t GROUP BY k ORDER BY 1
SELECT u.name, o.total FROM users u LEFT JOIN orders o ON o.user_id=u.id ORDER BY u.id, o.id
SELECT name FROM users WHERE id IN (SELECT user_id FROM orders) ORDER BY 1
SELECT name, id NOT IN (SELECT user_id FROM orders) FROM users ORDER BY 1
SELECT name, (SELECT total FROM orders WHERE user_id=users.id ORDER BY total DESC LIMIT 1) FROM users ORDER BY id
SELECT name FROM users WHERE EXISTS (SELECT 1 FROM orders WHERE user_id=users.id AND total>10)
SELECT id, row_number() OVER (PARTITION BY g ORDER BY v, id), rank() OVER (ORDER BY g), sum(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t ORDER BY id
SELECT id, sum(v) OVER (ORDER BY g GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t ORDER BY id
SELECT id, sum(v) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), count(*) OVER (ORDER BY g RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), max(v) OVER (ORDER BY g GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) FROM t ORDER BY id
SELECT id, count(*) FILTER (WHERE v>1) OVER (ORDER BY id) FROM t ORDER BY id
WITH RECURSIVE c(x) AS (VALUES(1) UNION ALL SELECT x+1 FROM c WHERE x<5) SELECT x FROM c
WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x+1)%4 FROM c) SELECT x FROM c ORDER BY 1
SELECT 1 UNION SELECT 2 UNION ALL SELECT 2 EXCEPT SELECT 1
SELECT NULL IS NULL, 1 IS NOT 2, NULL = 1, 1 BETWEEN 0 AND 2, 3 IN (1,2,NULL), (1,2)<(1,3), NOT 1=2
SELECT 'abc' LIKE 'A%', 'abc' GLOB 'a*', 'a_c' LIKE 'a!_c' ESCAPE '!', 'abc' LIKE '_b_'
SELECT CASE 1 WHEN 1 THEN 'x' ELSE 'y' END, CAST('12ab' AS INTEGER), CAST(3.9 AS INTEGER), CAST(5 AS TEXT), typeof(1.0), typeof('x'), typeof(NULL)
SELECT substr('hello',2,3), substr('hello',-3,2), substr('hello',0,2), substr('hello',4,-2), length('é'), upper('aé'), trim('  x '), replace('abab','a','z'), instr('hello','l'), hex('é'), quote('it''s'), char(72,105), unicode('é')
SELECT abs(-3), round(2.5), round(1.2345,2), max(1,2,3), min(3,NULL), coalesce(NULL,2), nullif(1,1), iif(1,'a','b')
SELECT date('2024-01-31','+1 month'), datetime('2024-02-29 12:34:56','-1 year'), time('12:00','+90 minutes'), strftime('%Y-%j-%w-%W-%H','2024-03-05 06:07:08'), julianday('2000-01-01 12:00'), unixepoch('2024-01-01'), date('2024-01-01','weekday 3'), date('2024-05-17','start of year')
SELECT sqrt(16), pow(2,10), ln(1), log(100), log(2,8), sign(-3), trunc(-2.7), ceil(2.1), floor(-2.1), mod(7,3), degrees(0)
SELECT json_extract('{"a":{"b":[1,2,3]}}','$.a.b[1]'), '{"a":1}'->>'a', '{"a":[1]}'->'$.a', json_array(1,'x',NULL), json_object('a',1,'b','c'), json_type('[1]'), json_valid('{x}'), json_array_length('[1,2]'), json('{"a" : 1}')
SELECT json_set('{"a":1}','$.b',2), json_remove('{"a":1,"b":2}','$.a'), json_patch('{"a":1}','{"a":null,"c":3}'), json_insert('[1]','$[#]',2), json_quote('x'), json_replace('{"a":1}','$.a','z')
SELECT key, value, type, fullkey, path FROM json_each('{"a":1,"b":[2]}')
SELECT u.name, j.value FROM users u, json_each('[1,2]') j WHERE j.value < u.id ORDER BY 1,2
SELECT g, v FROM t ORDER BY v DESC NULLS LAST, id LIMIT 3 OFFSET 1
SELECT g, max(v), id FROM t WHERE v IS NOT NULL AND id<>5 GROUP BY g ORDER BY g
SELECT count(*) FROM t HAVING count(*) > 100
SELECT DISTINCT g FROM t ORDER BY g
SELECT * FROM users NATURAL JOIN (SELECT 1 AS id, 'q' AS z)
SELECT * FROM users u FULL JOIN orders o ON u.id=o.user_id ORDER BY u.id, o.id
SELECT sum(total) OVER (ORDER BY id) AS s, lag(id,1,0) OVER (ORDER BY id), ntile(2) OVER (ORDER BY id), first_value(id) OVER w, nth_value(id,2) OVER w FROM orders WINDOW w AS (ORDER BY id)
SELECT json_group_array(id), json_group_object(name,id) FROM users
SELECT x'4142', hex(x'01ff'), typeof(x'00'), length(x'0102'), 1e20, 1.0, 0.1+0.2, 123456789012.0
SELECT 1 WHERE 'abc' AND 1
SELECT id FROM t WHERE v = '5' ORDER BY id
SELECT 'a' < 1, 2 < 'a', '10' < 9, x'00' > 'z'
SELECT rank() OVER (ORDER BY sum(v) DESC), g, sum(v) FROM t GROUP BY g ORDER BY g
""".strip().split("\n")

#: Statements run in order; those with ? are compared by their rows.
SEQUENCES = [
    r"""CREATE TABLE c(key TEXT PRIMARY KEY, value INTEGER)
INSERT INTO c VALUES ('a',1)
INSERT INTO c VALUES ('a',5),('b',2),('b',3) ON CONFLICT(key) DO UPDATE SET value = value + excluded.value
?SELECT key, value FROM c ORDER BY 1
INSERT OR IGNORE INTO c VALUES ('a',100),('z',9)
INSERT OR REPLACE INTO c VALUES ('a',77)
?SELECT * FROM c ORDER BY 1
INSERT INTO c VALUES ('a',1)
?SELECT count(*) FROM c
UPDATE c SET value = value*2 WHERE key > 'a'
DELETE FROM c WHERE value IS NULL OR value > 70
?SELECT * FROM c ORDER BY 1
?INSERT INTO c VALUES ('q',1) RETURNING key, value+1 AS w
REPLACE INTO c(key) VALUES ('q')
?SELECT *, changes() FROM c ORDER BY 1""",
    r"""CREATE TABLE dest(id INTEGER PRIMARY KEY, total INTEGER)
CREATE TABLE src(id INTEGER, amount INTEGER)
INSERT INTO dest VALUES (1,0),(2,5)
INSERT INTO src VALUES (1,10),(2,7)
UPDATE dest SET total = total + src.amount FROM src WHERE src.id = dest.id
?SELECT * FROM dest ORDER BY id""",
    r"""PRAGMA foreign_keys=ON
CREATE TABLE parent(id INTEGER PRIMARY KEY)
CREATE TABLE child(id INTEGER PRIMARY KEY, p INTEGER REFERENCES parent(id) ON DELETE CASCADE ON UPDATE CASCADE)
INSERT INTO parent VALUES (1),(2),(3)
INSERT INTO child VALUES (10,1),(11,2),(12,NULL)
INSERT INTO child VALUES (13,99)
DELETE FROM parent WHERE id=1
UPDATE parent SET id=20 WHERE id=2
?SELECT * FROM child ORDER BY id""",
    r"""CREATE TABLE items(id INTEGER PRIMARY KEY, name TEXT)
CREATE TABLE log(id INTEGER PRIMARY KEY AUTOINCREMENT, msg TEXT)
CREATE TRIGGER ai AFTER INSERT ON items BEGIN INSERT INTO log(msg) VALUES ('ins ' || new.name); END
CREATE TRIGGER au AFTER UPDATE OF name ON items WHEN old.name <> new.name BEGIN INSERT INTO log(msg) VALUES (old.name || '->' || new.name); END
CREATE TRIGGER bd BEFORE DELETE ON items BEGIN SELECT RAISE(ABORT, 'no') WHERE old.id = 1; END
INSERT INTO items(name) VALUES ('x'),('y')
UPDATE items SET name='z' WHERE id=2
DELETE FROM items WHERE id=1
DELETE FROM items WHERE id=2
?SELECT * FROM log ORDER BY id
?SELECT * FROM items ORDER BY id""",
    r"""CREATE TABLE g(a INTEGER NOT NULL CHECK(a>0), b INTEGER GENERATED ALWAYS AS (a*2) STORED, c TEXT DEFAULT 'd', UNIQUE(c))
INSERT INTO g(a) VALUES (1)
INSERT INTO g(a,c) VALUES (2,'e')
INSERT INTO g(a,c) VALUES (-1,'f')
INSERT INTO g(a,c) VALUES (NULL,'f')
INSERT INTO g(a) VALUES (3)
?SELECT a,b,c FROM g ORDER BY a
BEGIN
DELETE FROM g
SAVEPOINT s
INSERT INTO g(a,c) VALUES (9,'n')
ROLLBACK TO s
ROLLBACK
?SELECT count(*) FROM g
ALTER TABLE g ADD COLUMN d INTEGER DEFAULT 4
ALTER TABLE g RENAME COLUMN c TO cc
?SELECT a,cc,d FROM g ORDER BY a
CREATE UNIQUE INDEX gi ON g(d)
CREATE INDEX gj ON g(a DESC, cc COLLATE NOCASE)
?PRAGMA table_info(g)
?SELECT name, "unique", origin FROM pragma_index_list('g') ORDER BY 1
?SELECT type, name, tbl_name FROM sqlite_schema ORDER BY 1,2""",
    r"""CREATE TABLE m(x, i INTEGER, t TEXT, r REAL, n NUMERIC)
INSERT INTO m VALUES (1, '12', 12, 3, '1.50')
INSERT INTO m VALUES (2, 'abc', 1.5, 'q', 7)
CREATE VIEW vw(a, b) AS SELECT x, t FROM m WHERE x > 1
?SELECT * FROM vw
CREATE TRIGGER vi INSTEAD OF INSERT ON vw BEGIN INSERT INTO m(x,t) VALUES (new.a, new.b); END
INSERT INTO vw VALUES (5,'five')
?SELECT x,t FROM m ORDER BY x
CREATE TABLE cp AS SELECT x AS y, t FROM m
?SELECT y FROM cp ORDER BY 1
CREATE TABLE kv(a INTEGER, b INTEGER, v TEXT, PRIMARY KEY(a,b)) WITHOUT ROWID
INSERT INTO kv VALUES (1,1,'x'),(1,2,'y')
INSERT INTO kv VALUES (1,1,'z')
?SELECT * FROM kv ORDER BY a,b
?SELECT rowid, x FROM m ORDER BY rowid""",
    r"""CREATE VIRTUAL TABLE d USING fts5(title, body)
INSERT INTO d VALUES ('hello world','sqlite is great'),('goodbye','hello moon'),('sqlite tutorial','hello world and sqlite')
?SELECT title FROM d WHERE d MATCH 'hello' ORDER BY rowid
?SELECT title FROM d WHERE d MATCH '"hello world"' ORDER BY rowid
?SELECT title FROM d WHERE d MATCH 'title:sqlite OR moon' ORDER BY rowid
?SELECT title FROM d WHERE d MATCH 'sql*' ORDER BY rowid
?SELECT title FROM d WHERE d MATCH 'hello NOT world' ORDER BY rowid
?SELECT title FROM d WHERE d MATCH 'NEAR(hello sqlite, 3)' ORDER BY rowid
?SELECT highlight(d,1,'<','>') FROM d WHERE d MATCH 'hello' ORDER BY rowid
?SELECT title, round(bm25(d),6) FROM d WHERE d MATCH 'sqlite' ORDER BY bm25(d)""",
]


def plain(rows):
    def one(x):
        return round(x, 6) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x

    return [tuple(str(one(x)) for x in r) for r in rows]


@pytest.fixture(scope="module")
def pair(spark):
    ours, theirs = Database(spark), sqlite3.connect(":memory:")
    ours.exec(SCRIPT)
    theirs.executescript(SCRIPT)
    return ours, theirs


@pytest.mark.parametrize("sql", QUERIES)
def test_query(pair, sql):
    ours, theirs = pair
    assert plain(map(tuple, ours.query(sql).collect())) == plain(theirs.execute(sql).fetchall())


@pytest.mark.parametrize("sequence", SEQUENCES)
def test_sequence(spark, sequence):
    ours, theirs = Database(spark), sqlite3.connect(":memory:", isolation_level=None)
    for line in sequence.split("\n"):
        sql, shown = line.lstrip("?"), line.startswith("?")
        try:
            want = theirs.execute(sql).fetchall()
        except sqlite3.Error as e:
            with pytest.raises(SqlError, match=".*"):
                ours.query(sql)
            assert str(e)
            continue
        got = ours.query(sql)
        if shown:
            assert plain(map(tuple, got.collect())) == plain(want), sql


def test_metamorphic_partition(spark):
    """Every row satisfies a predicate, or its negation, or leaves it unknown."""
    db = Database(spark)
    db.exec("CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER, b TEXT)")
    db.exec("INSERT INTO t VALUES " + ", ".join(f"({i}, {'NULL' if i % 5 == 0 else i % 7}, {'NULL' if i % 3 == 0 else repr(str(i % 4))})" for i in range(1, 41)))
    for p in ("a > 3", "b = '1'", "a > 2 OR b < '2'", "a IN (1, NULL)", "b LIKE '1%'", "a BETWEEN 1 AND a * 2 - 3", "(a, b) < (4, '2')"):
        parts = [r[0] for w in (p, f"NOT ({p})", f"({p}) IS NULL") for r in db.query(f"SELECT id FROM t WHERE {w}").collect()]
        assert sorted(parts) == list(range(1, 41)), p


def test_parameters_and_statements(spark):
    db = Database(spark)
    db.exec("CREATE TABLE t(k INTEGER PRIMARY KEY, v TEXT)")
    st = db.prepare("INSERT INTO t(v) VALUES (?)")
    assert st.run("a").last_insert_rowid == 1 and st.run("b").last_insert_rowid == 2
    assert db.prepare("SELECT v FROM t WHERE k = :k").get({":k": 2}) == {"v": "b"}
    assert db.prepare("SELECT ?2 || ?1 AS x").all("1", "2") == [{"x": "21"}]
    with pytest.raises(SqlError):
        db.query("SELECT ?", [float("inf")])


def test_transactions_and_snapshots(spark, tmp_path):
    db = Database(spark)
    db.exec("CREATE TABLE t(k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'); CREATE VIEW w AS SELECT v FROM t; CREATE UNIQUE INDEX i ON t(v)")
    with pytest.raises(RuntimeError), db.transaction():
        db.exec("DELETE FROM t")
        raise RuntimeError
    assert db.query("SELECT count(*) FROM t").first()[0] == 1
    folder = db.snapshot().encode(str(tmp_path / "snap"))
    from larkspur.api import Snapshot

    again = Snapshot.decode(spark, folder).open()
    again.exec("INSERT INTO t(v) VALUES ('b')")
    assert [r[0] for r in again.query("SELECT v FROM w ORDER BY 1").collect()] == ["a", "b"]
    assert db.query("SELECT count(*) FROM t").first()[0] == 1
    with pytest.raises(SqlError, match="UNIQUE"):
        again.exec("INSERT INTO t(v) VALUES ('b')")


@pytest.mark.parametrize("sql", ["SELECT", "SELECT * FROM nowhere", "SELECT x", "SELECT a FROM (SELECT 1 AS a), (SELECT 2 AS a)", "SELECT sum(1) OVER (ROWS -1 PRECEDING)", "SELECT 1 UNION SELECT 1, 2", "SELECT nofunc(1)", "SELECT abs()", "SELECT 1 LIMIT 'x'", "SELECT lag(1) IGNORE NULLS OVER ()", "INSERT INTO nowhere VALUES (1)", "SELECT (SELECT 1, 2)"])
def test_errors(spark, sql):
    with pytest.raises(SqlError):
        Database(spark).query(sql)


def test_first_row_of_a_correlated_subquery(spark):
    db, lite = Database(spark), sqlite3.connect(":memory:")
    rows = [(i, i % 7, i * 37 % 11, "abC"[i % 3]) for i in range(60)] + [(60, None, 1, "a"), (61, 3, None, None)]
    for run in (db.exec, lite.executescript):
        run("CREATE TABLE c(k INTEGER PRIMARY KEY); CREATE TABLE o(id INTEGER PRIMARY KEY, k INTEGER, p INTEGER, s TEXT)")
        run("INSERT INTO c VALUES " + ", ".join(f"({k})" for k in range(9)))
        run("INSERT INTO o VALUES " + ", ".join(str(r).replace("None", "NULL") for r in rows))
    for tail in ("ORDER BY p DESC, id LIMIT 1", "ORDER BY p, id DESC", "ORDER BY s COLLATE NOCASE DESC, p * 2, id LIMIT 1 OFFSET 2", "ORDER BY 1 DESC LIMIT 5", "ORDER BY p LIMIT 0"):
        sql = f"SELECT k, (SELECT id FROM o WHERE o.k = c.k {tail}) FROM c ORDER BY 1"
        df = db.query(sql)
        assert [tuple(r) for r in df.collect()] == lite.execute(sql).fetchall(), tail
        if "p DESC" in tail:  # the rows are numbered in the order asked for, not in that of their arrival
            windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x and "Window" in x]
            assert windows and all("DESC" in x for x in windows)
