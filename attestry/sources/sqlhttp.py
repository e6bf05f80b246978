"""SQL over HTTP as a Spark data source.

The protocol is the ``/v2/pipeline`` one of SQLite servers: a POST with a list of
``execute`` requests, typed arguments in, typed cells out.

Reading: ranges of a numeric ``partitionColumn`` are partitions, filters that the
server understands become its ``where`` clause (``spark.sql.python.filterPushdown.enabled``
must be true), and with a unique ``key`` column a partition is read in pages of
``fetchSize`` rows, each beginning after the last key, so that no answer is large
and a page can be asked for again.

Writing: tasks fill a staging table, each row with the name of its task's attempt.
The driver's commit moves the rows of the attempts that Spark counts into the table
and drops the staging table, in one transaction; so rows of lost or repeated tasks
never show, and a failed job leaves the table as it was.  With ``key``, rows that are
there already are updated.

Options: ``url``, ``table``, ``token``, ``columns`` (comma-separated; all), ``partitionColumn``
with ``lowerBound``, ``upperBound`` and ``numPartitions``, ``key``, ``fetchSize`` (10000),
``batchSize`` (500), ``retries`` (3), ``timeout`` seconds (60).
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T


class HttpSqlError(Exception):
    """What the server said, or why it can't be reached."""


def typed(value: Any) -> dict[str, Any]:
    """A value as an argument."""
    match value:
        case None:
            return {"type": "null"}
        case bool():
            return {"type": "integer", "value": str(int(value))}
        case int():
            return {"type": "integer", "value": str(value)}
        case float() if value != value:
            return {"type": "null"}
        case float():
            return {"type": "integer", "value": str(int(value))} if value.is_integer() and abs(value) < 2**53 else {"type": "float", "value": value}
        case bytes() | bytearray():
            return {"type": "blob", "base64": base64.b64encode(value).decode().rstrip("=")}
        case datetime() | date():
            return {"type": "text", "value": value.isoformat()}
        case Decimal():
            return {"type": "text", "value": str(value)}
        case _:
            return {"type": "text", "value": str(value)}


def plain(cell: Any) -> Any:
    """A cell as a value; cells may be bare."""
    if not isinstance(cell, dict):
        return cell
    match cell.get("type"):
        case "integer":
            return int(cell["value"])
        case "float":
            return float(cell["value"])
        case "blob":
            raw = cell.get("base64", cell.get("value", ""))
            return base64.b64decode(raw + "=" * (-len(raw) % 4))
        case "null":
            return None
        case _:
            return cell.get("value")


@dataclass(frozen=True)
class Client:
    """Sends statements; what fails on the way is tried again."""

    url: str
    token: str | None = None
    retries: int = 3
    timeout: float = 60.0

    def run(self, *statements: tuple[str, list[Any]]) -> list[tuple[list[str], list[str | None], list[list[Any]]]]:
        """Names, declared types and rows of each statement, all sent at once."""
        body = json.dumps({"requests": [{"type": "execute", "stmt": {"sql": sql, "args": [typed(a) for a in args]}} for sql, args in statements]}).encode()
        out = []
        for result in self._post(body).get("results", []):
            if result.get("type") != "ok":
                raise HttpSqlError(result.get("error", {}).get("message", "the statement failed"))
            got = result["response"]["result"]
            out.append(([c["name"] for c in got["cols"]], [c.get("decltype") for c in got["cols"]], [[plain(c) for c in row] for row in got["rows"]]))
        if len(out) != len(statements):
            raise HttpSqlError(f"{len(statements)} statements, {len(out)} results")
        return out

    def _post(self, body: bytes) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        url = self.url.replace("libsql:", "https:", 1).rstrip("/") + "/v2/pipeline"
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in (429, 500, 502, 503, 504) or attempt == self.retries:
                    raise HttpSqlError(f"HTTP {e.code}: {e.read()[:500].decode(errors='replace')}") from None
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == self.retries:
                    raise HttpSqlError(f"{url}: {e}") from None
            time.sleep(min(0.2 * 2**attempt, 5))
        raise AssertionError


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _client(options: Any) -> Client:
    return Client(options["url"], options.get("token"), int(options.get("retries", 3)), float(options.get("timeout", 60)))


_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def clause(f: ds.Filter, numeric: set[str]) -> tuple[str, list[Any]] | None:
    """A filter as SQL with arguments; None if the server might see it differently.

    Order is compared for numbers only (texts may have another collation), and
    ``Not`` keeps rows whose condition is null out, as Spark does.
    """
    match f:
        case ds.IsNull(attribute=(name,)):
            return f"{quoted(name)} is null", []
        case ds.IsNotNull(attribute=(name,)):
            return f"{quoted(name)} is not null", []
        case ds.EqualNullSafe(attribute=(name,), value=value):
            return f"{quoted(name)} is ?", [value]
        case ds.In(attribute=(name,), value=values) if len(values) <= 500:
            return f"{quoted(name)} in ({', '.join('?' * len(values))})", list(values)
        case ds.StringStartsWith(attribute=(name,), value=value):
            return f"substr({quoted(name)}, 1, {len(value)}) = ?", [value]
        case ds.StringContains(attribute=(name,), value=value):
            return f"instr({quoted(name)}, ?) > 0", [value]
        case ds.Not(child=child):
            inner = clause(child, numeric)
            return None if inner is None else (f"not ({inner[0]})", inner[1])
        case ds.EqualTo(attribute=(name,), value=value) if not isinstance(value, (datetime, date, Decimal)):
            return f"{quoted(name)} = ?", [value]
        case ds.GreaterThan() | ds.GreaterThanOrEqual() | ds.LessThan() | ds.LessThanOrEqual() if len(f.attribute) == 1 and f.attribute[0] in numeric:
            return f"{quoted(f.attribute[0])} {_SIGNS[type(f)]} ?", [f.value]
    return None


@dataclass
class Range(ds.InputPartition):
    """From ``low`` to below ``high``; an open end has all that lies beyond it, the first one nulls too."""

    low: float | None
    high: float | None

    def where(self, column: str) -> list[tuple[str, list[Any]]]:
        c = quoted(column)
        if self.low is None:
            return [] if self.high is None else [(f"({c} < ? or {c} is null)", [self.high])]
        return [(f"{c} >= ?", [self.low])] + ([(f"{c} < ?", [self.high])] if self.high is not None else [])


class Reader(ds.DataSourceReader):
    def __init__(self, options: Any, schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.pushed: list[tuple[str, list[Any]]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        numeric = {f.name for f in self.schema if isinstance(f.dataType, T.NumericType)}
        for f in filters:
            found = clause(f, numeric)
            if found is None:
                yield f
            else:
                self.pushed.append(found)

    def partitions(self) -> list[Range]:
        o = self.options
        n = int(o.get("numpartitions", 1))
        if "partitioncolumn" not in o or n <= 1:
            return [Range(None, None)]
        low, high = int(o["lowerbound"]), int(o["upperbound"])
        cuts = sorted({low + (high - low) * i // n for i in range(1, n)})
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        o, client = self.options, _client(self.options)
        names, key, size = self.schema.names, o.get("key"), int(o.get("fetchsize", 10_000))
        wanted = [*names, *([key] if key and key not in names else [])]
        limits = [*self.pushed, *(partition.where(o["partitioncolumn"]) if "partitioncolumn" in o else [])]
        after: list[tuple[str, list[Any]]] = []
        kinds = [f.dataType for f in self.schema]
        while True:
            each = [*limits, *after]
            sql = f"select {', '.join(map(quoted, wanted))} from {quoted(o['table'])}"
            sql += " where " + " and ".join(c for c, _ in each) if each else ""
            sql += f" order by {quoted(key)} limit {size}" if key else ""
            ((_, _, rows),) = client.run((sql, [a for _, args in each for a in args]))
            for row in rows:
                yield tuple(_as(v, kind) for v, kind in zip(row, kinds, strict=False))
            if not key or len(rows) < size:
                return
            after = [(f"{quoted(key)} > ?", [rows[-1][wanted.index(key)]])]


def _as(value: Any, kind: T.DataType) -> Any:
    """A cell in the type that Spark was told."""
    match kind:
        case _ if value is None:
            return None
        case T.StringType():
            return value if isinstance(value, str) else str(value)
        case T.DoubleType() | T.FloatType():
            return float(value)
        case T.BooleanType():
            return bool(int(value))
        case T.IntegralType():
            return int(value)
        case T.DecimalType():
            return Decimal(str(value))
        case T.TimestampType() | T.TimestampNTZType():
            return datetime.fromisoformat(value)
        case T.DateType():
            return date.fromisoformat(value)
    return value


@dataclass
class Done(ds.WriterCommitMessage):
    attempt: str
    rows: int


class Writer(ds.DataSourceWriter):
    def __init__(self, options: Any, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = dict(options), schema, overwrite
        self.stage = f"{self.options['table']}__stage_{uuid.uuid4().hex}"
        names = ", ".join(quoted(n) for n in schema.names)
        make = f"create table if not exists {quoted(self.stage)} as select '' as \"_attempt\", 0 as \"_place\", {names} from {quoted(self.options['table'])} where 0"
        _client(self.options).run((make, []), (f'create unique index if not exists {quoted(self.stage + "_i")} on {quoted(self.stage)} ("_attempt", "_place")', []))

    def write(self, iterator: Iterator[Any]) -> Done:
        from pyspark import TaskContext

        context, client = TaskContext.get(), _client(self.options)
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        width = len(self.schema.names) + 2
        most = max(1, min(int(self.options.get("batchsize", 500)), 900 // width))  # 999 arguments a statement
        total, sent, held = 0, 0, []

        def send() -> None:
            # The place is unique in the stage, so a batch whose answer was lost can be sent again.
            nonlocal sent, held
            marks = ", ".join(f"({', '.join('?' * width)})" for _ in held)
            client.run((f"insert or ignore into {quoted(self.stage)} values {marks}", [v for i, row in enumerate(held, sent) for v in (attempt, i, *row)]))
            sent, held = sent + len(held), []

        for row in iterator:
            held.append(row)
            total += 1
            if len(held) == most:
                send()
        if held:
            send()
        return Done(attempt, total)

    def commit(self, messages: list[Done | None]) -> None:
        done = [m for m in messages if m is not None]
        table, key = quoted(self.options["table"]), self.options.get("key")
        names = ", ".join(quoted(n) for n in self.schema.names)
        rest = [n for n in self.schema.names if n != key]
        update = f" on conflict ({quoted(key)}) do update set " + ", ".join(f"{quoted(n)} = excluded.{quoted(n)}" for n in rest) if key and rest else f" on conflict ({quoted(key)}) do nothing" if key else ""
        steps: list[tuple[str, list[Any]]] = [("begin immediate", [])]
        if self.overwrite:
            steps.append((f"delete from {table}", []))
        for i in range(0, len(done), 500):
            part = [m.attempt for m in done[i : i + 500]]
            steps.append((f"insert into {table} ({names}) select {names} from {quoted(self.stage)} where \"_attempt\" in ({', '.join('?' * len(part))})" + update, part))
        steps += [(f"drop table {quoted(self.stage)}", []), ("commit", [])]
        client = _client(self.options)
        for attempt in range(client.retries + 1):
            try:
                replace(client, retries=0).run(*steps)
                return
            except HttpSqlError:
                # The staging table goes with the commit: without it, only the answer was lost.
                ((_, _, there),) = client.run(("select count(*) from sqlite_master where name = ?", [self.stage]))
                if not there[0][0]:
                    return
                if attempt == client.retries:
                    raise

    def abort(self, messages: list[Done | None]) -> None:
        _client(self.options).run((f"drop table if exists {quoted(self.stage)}", []))


class HttpSql(ds.DataSource):
    """``spark.read.format("sqlhttp")`` and ``df.write.format("sqlhttp")``, once ``register`` has been called."""

    @classmethod
    def name(cls) -> str:
        return "sqlhttp"

    def schema(self) -> T.StructType:
        """From the declared types: integers, reals, blobs; all else is text."""
        columns = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None
        chosen = ", ".join(map(quoted, columns)) if columns else "*"
        ((names, declared, _),) = _client(self.options).run((f"select {chosen} from {quoted(self.options['table'])} limit 0", []))
        return T.StructType([T.StructField(n, _kind(d)) for n, d in zip(names, declared, strict=True)])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(_lowered(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(_lowered(self.options), schema, overwrite)


def _lowered(options: Any) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


def _kind(declared: str | None) -> T.DataType:
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSql)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
