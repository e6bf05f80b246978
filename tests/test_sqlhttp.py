"""SQL over HTTP against a local server in front of SQLite."""

import base64
import json
import sqlite3
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from attestry.sources import sqlhttp


class Server:
    """Answers pipelines from a SQLite file; keeps the statements, and fails when told to."""

    def __init__(self, path):
        self.path, self.seen, self.fail, self.lock = path, [], [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                code, answer = outer.answer(body, self.headers.get("Authorization"))
                raw = json.dumps(answer).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def answer(self, body, token):
        with self.lock:
            if token != "Bearer secret":
                return 401, {"message": "no"}
            statements = [r["stmt"] for r in body["requests"]]
            self.seen += [s["sql"] for s in statements]
            code = next((self.fail.pop(i)[1] for i, (word, _) in enumerate(self.fail) if word in statements[0]["sql"]), None)
            db = sqlite3.connect(self.path, isolation_level=None)
            results = []
            for s in statements:
                try:
                    cursor = db.execute(s["sql"], [self.value(a) for a in s["args"]])
                    cols = [{"name": c[0], "decltype": self.kind(db, c[0])} for c in cursor.description or []]
                    results.append({"type": "ok", "response": {"type": "execute", "result": {"cols": cols, "rows": [[self.cell(v) for v in r] for r in cursor], "affected_row_count": cursor.rowcount, "last_insert_rowid": None}}})
                except sqlite3.Error as e:
                    results.append({"type": "error", "error": {"message": str(e)}})
                    break
            db.close()  # an open transaction is rolled back
            return (code, {"message": "lost"}) if code else (200, {"results": results})

    @staticmethod
    def kind(db, name):
        return {r[1]: r[2] for r in db.execute("pragma table_info(people)")}.get(name)

    @staticmethod
    def value(a):
        return {"null": lambda: None, "integer": lambda: int(a["value"]), "float": lambda: a["value"], "text": lambda: a["value"], "blob": lambda: base64.b64decode(a["base64"] + "==")}[a["type"]]()

    @staticmethod
    def cell(v):
        return {"type": "null"} if v is None else {"type": "integer", "value": str(v)} if isinstance(v, int) else {"type": "float", "value": v} if isinstance(v, float) else {"type": "blob", "base64": base64.b64encode(v).decode()} if isinstance(v, bytes) else {"type": "text", "value": v}

    def rows(self, sql="select * from people order by id"):
        db = sqlite3.connect(self.path)
        try:
            return db.execute(sql).fetchall()
        finally:
            db.close()


PEOPLE = [(i, None if i % 7 == 0 else f"n{i % 5}'\"%", i / 4, None if i % 3 else bytes([i % 256, 0])) for i in range(1, 61)]


@pytest.fixture()
def server(tmp_path):
    s = Server(str(tmp_path / "db"))
    db = sqlite3.connect(s.path)
    db.execute("create table people (id integer primary key, name text, score real, raw blob)")
    db.executemany("insert into people values (?, ?, ?, ?)", PEOPLE)
    db.commit()
    db.close()
    yield s
    s.http.shutdown()


def reader(spark, server, **options):
    sqlhttp.register(spark)
    return spark.read.format("sqlhttp").options(url=server.url, token="secret", table="people", retries="1", **options)


def got(df):
    return sorted((r.id, r.name, r.score, None if r.raw is None else bytes(r.raw)) for r in df.collect())


def test_whole_table_in_ranges_and_pages(spark, server):
    df = reader(spark, server, partitionColumn="id", lowerBound="0", upperBound="60", numPartitions="4", key="id", fetchSize="6").load()
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("id", "bigint"), ("name", "string"), ("score", "double"), ("raw", "binary")]
    assert df.rdd.getNumPartitions() == 4
    assert got(df) == PEOPLE
    pages = [s for s in server.seen if "limit 6" in s]
    assert len(pages) >= 10 and any('"id" > ?' in s for s in pages) and any("is null" in s for s in pages)


@pytest.mark.parametrize(
    ("condition", "pushed"),
    [
        ("id = 7", '"id" = ?'),
        ("score > 3.5 and id <= 40", '"score" > ?'),
        ("name is null", '"name" is null'),
        ("name is not null and name like 'n1%'", "substr("),
        ("contains(name, '\"%')", "instr("),
        ("id in (3, 5, 70)", '"id" in (?, ?, ?)'),
        ("not (id = 7) and name = 'n2\\'\"%'", '"name" = ?'),
        ("name <=> null", None),
        ("name > 'n2'", None),
        ("length(name) = 5 and id > 30", '"id" > ?'),
    ],
)
def test_filters_reach_the_server(spark, server, condition, pushed):
    df = reader(spark, server, key="id").load()
    want = spark.createDataFrame(PEOPLE, df.schema)
    server.seen.clear()
    assert got(df.where(condition)) == got(want.where(condition)) != []
    wheres = [s.partition(" where ")[2] for s in server.seen if "limit 0" not in s]
    assert wheres and (pushed is None or all(pushed in w for w in wheres))


def test_errors_and_retries(spark, server):
    server.fail.append(("order by", 503))
    assert got(reader(spark, server, key="id").load()) == PEOPLE
    with pytest.raises(Exception, match="401"):
        reader(spark, server).option("token", "wrong").load()
    with pytest.raises(Exception, match="no such table"):
        reader(spark, server).option("table", "nothing").load()


def write(df, server, mode="append", **options):
    df.write.format("sqlhttp").options(url=server.url, token="secret", table="people", batchSize="7", retries="2", **options).mode(mode).save()


def test_append_upsert_overwrite(spark, server):
    sqlhttp.register(spark)
    schema = reader(spark, server).load().schema
    new = [(i, f"new {i}", 0.5, b"\x01") for i in range(100, 130)]
    server.fail += [("insert or ignore", 503), ("begin", 503)]  # the rows are there, the answers are lost
    write(spark.createDataFrame(new, schema).repartition(3), server)
    assert server.rows() == [*PEOPLE, *new]
    write(spark.createDataFrame([(100, "again", None, None), (200, "more", 1.0, None)], schema), server, key="id")
    assert server.rows("select * from people where id in (100, 101, 200) order by id") == [(100, "again", None, None), new[1], (200, "more", 1.0, None)]
    write(spark.createDataFrame(PEOPLE[:3], schema), server, mode="overwrite")
    assert server.rows() == PEOPLE[:3]
    assert server.rows("select count(*) from sqlite_master where name like '%stage%'") == [(0,)]


def test_failed_job_leaves_the_table(spark, server):
    """One task fails after another has sent its rows; or the commit breaks a key."""
    sqlhttp.register(spark)
    schema = reader(spark, server).load().schema
    df = spark.createDataFrame([(i, "x", 1.0, None) for i in range(300, 340)], schema).repartition(2)
    broken = df.withColumn("name", F.when(F.col("id") == 317, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        write(broken, server)
    with pytest.raises(Exception, match="UNIQUE"):
        write(spark.createDataFrame([(1, "x", 1.0, None), (900, "y", 1.0, None)], schema), server)
    assert server.rows() == PEOPLE
    assert server.rows("select count(*) from sqlite_master where name like '%stage%' and type = 'table'") == [(0,)]


def test_typed_values():
    for value in (None, 7, -(2**60), 0.25, "a", "", b"\x00\xff"):
        assert sqlhttp.plain(json.loads(json.dumps(sqlhttp.typed(value)))) == value
    assert sqlhttp.typed(True) == {"type": "integer", "value": "1"} and sqlhttp.typed(3.0) == {"type": "integer", "value": "3"}
    assert sqlhttp.typed(date(2024, 1, 2)) == {"type": "text", "value": "2024-01-02"} and sqlhttp.typed(float("nan")) == {"type": "null"}
