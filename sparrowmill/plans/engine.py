"""A database over a Spark session: tables with snapshot versions, views, prepared statements, meta tables, and a dispatcher
for statements. Queries are lazy DataFrames; data definition and manipulation act at once.

A table is a pointer to an immutable DataFrame; a view is a text. A transaction works on a copy of the pointers; committing swaps the changed
ones if no one else did since (the first committer wins), rolling back drops them.
"""

from __future__ import annotations

import logging
import os
import platform
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from . import dialect

#: Types of CREATE TABLE. Dates and booleans are strings, lengths don't count.
COLUMN_TYPES = {
    "int": "int", "integer": "int", "smallint": "int", "bigint": "bigint", "long": "bigint", "float": "float", "real": "float", "decimal": "float",
    "double": "double", "char": "string", "varchar": "string", "text": "string", "string": "string", "date": "string", "datetime": "string", "timestamp": "string", "time": "string", "boolean": "string",
}


class Conflict(Exception):
    """Another transaction changed a table that this one changed too."""


def split_top(text: str, separator: str) -> list[str]:
    """Split at separators outside quotes and parentheses."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == separator and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


@dataclass(frozen=True)
class View:
    """The text of a view's query, and names for its columns. It is run on the tables as they are when it is used."""

    text: str
    columns: tuple[str, ...] = ()


class Database:
    def __init__(self, spark: SparkSession, storage: str | None = None):
        """storage: a folder that driver and executors share, for the versions of changed tables."""
        self.spark, self.storage = spark, storage
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, View] = {}
        #: Temporary views are Spark's, which has one set of names for all threads.
        self.names = threading.RLock()
        self.prepared: dict[str, str] = {}
        self.constraints: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        self.sort_orders: dict[str, list[tuple[str, str]]] = {}
        self.plugins: dict[str, dict[str, Callable[[], None]]] = {}
        self.loaded: set[str] = set()
        self.settings: dict[str, tuple[str, str]] = {}
        self.log: list[tuple[int, str, int, str, str]] = []

    def note(self, reporter: str, message: str, level: int = logging.INFO) -> None:
        self.log.append((time.time_ns(), logging.getLevelName(level), level, reporter, message))

    def add(self, name: str, df: DataFrame) -> None:
        self.tables[name.lower()] = df

    def session(self) -> Session:
        return Session(self)

    def meta(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        """A meta table, made when asked for."""
        spark, kinds = self.spark, files.NAMES

        def chunks() -> DataFrame | None:
            out = None
            for n, df in sorted(tables.items()):
                part = df.groupBy(F.spark_partition_id().alias("chunk_id")).agg(F.count("*").alias("row_count"))
                part = part.select(F.lit(n).alias("table_name"), "chunk_id", "row_count", F.lit(0).cast("long").alias("invalid_row_count"), F.lit(None).cast("long").alias("cleanup_commit_id"))
                out = part if out is None else out.unionAll(part)
            return out

        if name == "tables":
            rows = [(n, len(df.columns), df.count(), df.rdd.getNumPartitions(), None) for n, df in sorted(tables.items())]
            return spark.createDataFrame(rows, "table_name string, column_count int, row_count long, chunk_count int, target_chunk_size long")
        if name == "columns":
            rows = [(n, f.name, kinds.get(type(f.dataType), f.dataType.simpleString()), int(f.nullable)) for n, df in sorted(tables.items()) for f in df.schema.fields]
            return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable int")
        if name == "chunks":
            return chunks() or spark.createDataFrame([], "table_name string, chunk_id int, row_count long, invalid_row_count long, cleanup_commit_id long")
        if name in ("segments", "segments_accurate"):
            out = []
            for n, df in sorted(tables.items()):
                out += [(n, i, f.name, kinds.get(type(f.dataType), f.dataType.simpleString()), d) for (i, f), d in zip(enumerate(df.schema.fields), df.agg(*(F.count_distinct(c) for c in df.columns)).first() or ())]
            return spark.createDataFrame(out, "table_name string, column_id int, column_name string, column_data_type string, distinct_value_count long")
        if name == "chunk_sort_orders":
            rows = [(n, None, tables[n].columns.index(c), order) for n, orders in sorted(self.sort_orders.items()) if n in tables for c, order in orders]
            return spark.createDataFrame(rows, "table_name string, chunk_id int, column_id int, order_mode string")
        if name == "settings":
            rows = [(k, v, d) for k, (v, d) in sorted(self.settings.items())] + [(k, v, "") for k, v in sorted(self.spark.sparkContext.getConf().getAll()) if k.startswith("spark.sql.")]
            return spark.createDataFrame(rows, "name string, value string, description string")
        if name == "plugins":
            return spark.createDataFrame([(n,) for n in sorted(self.loaded)], "name string")
        if name == "exec":
            return spark.createDataFrame([(p, f) for p in sorted(self.loaded) for f in sorted(self.plugins[p])], "plugin_name string, function_name string")
        if name == "log":
            rows = [(t, time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(t / 1e9)), level, i, who, what) for t, level, i, who, what in self.log]
            return spark.createDataFrame(rows, "timestamp long, time string, log_level string, log_level_id int, reporter string, message string")
        if name == "system_information":
            row = (platform.node(), platform.machine(), os.cpu_count(), os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"), spark.version)
            return spark.createDataFrame([row], "host string, cpu_model string, cpu_count int, system_memory_total_bytes long, engine_version string")
        if name == "system_utilization":
            return spark.createDataFrame([(*map(float, os.getloadavg()), time.process_time())], "load_average_1_min double, load_average_5_min double, load_average_15_min double, process_cpu_time_s double")
        raise KeyError(f"no meta table {name}")


_NAME = r"[A-Za-z_]\w*"


class Session:
    """Statements of one client; each commits by itself outside a transaction."""

    def __init__(self, database: Database):
        self.db, self.spark = database, database.spark
        self.own: dict[str, DataFrame | None] | None = None
        self.seen: dict[str, DataFrame] = {}

    # transactions

    def begin(self) -> None:
        if self.own is not None:
            raise RuntimeError("a transaction is open already")
        self.own, self.seen = {}, dict(self.db.tables)

    def commit(self) -> None:
        if self.own is None:
            raise RuntimeError("no transaction is open")
        own, seen = self.own, self.seen
        self.own = None
        if any(self.db.tables.get(n) is not seen.get(n) for n in own):
            raise Conflict(", ".join(sorted(own)))
        for n, df in own.items():
            if df is None:
                self.db.tables.pop(n, None)
            else:
                self.db.tables[n] = df

    def rollback(self) -> None:
        if self.own is None:
            raise RuntimeError("no transaction is open")
        self.own = None

    def visible(self) -> dict[str, DataFrame]:
        if self.own is None:
            return dict(self.db.tables)
        return {n: df for n, df in {**self.seen, **self.own}.items() if df is not None}

    def _set(self, name: str, df: DataFrame | None) -> None:
        if self.own is not None:
            self.own[name] = df
        elif df is None:
            self.db.tables.pop(name, None)
        else:
            self.db.tables[name] = df

    def _write(self, name: str, df: DataFrame) -> None:
        """A changed table. With a storage folder it is written there, so that later statements neither compute the change
        again nor read its sources; without one it stays a plan."""
        if self.db.storage:
            path = f"{self.db.storage}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self._set(name, df)

    def table(self, name: str) -> DataFrame:
        return self.visible()[name.lower()]

    # statements

    def run(self, text: str, args: list | None = None) -> DataFrame | None:
        """All statements of the text in order; the last one's result."""
        out = None
        for statement in dialect.statements(text):
            self.db.note("sql", statement[:200])
            out = self._one(statement, args)
        return out

    def query(self, text: str, args: list | None = None) -> DataFrame:
        """The result of a query in the engine's dialect (see `dialect`)."""
        with self.db.names:
            self._register(text, set())
            return dialect.query(self.spark, text, args)

    def _register(self, text: str, within: set[str]) -> None:
        """The tables, views and meta tables that the text names as Spark's temporary views; tables come before meta tables
        and these before views of one name."""
        named = {t.low.strip('"`') for t in dialect.tokens(text) if t.kind in ("name", "quoted")}
        tables = self.visible()
        for n in sorted(named):
            if n in tables:
                tables[n].createOrReplaceTempView(n)
            elif n.startswith("meta_"):
                self.db.meta(n.removeprefix("meta_"), tables).createOrReplaceTempView(n)
            elif n in self.db.views and n not in within:
                view = self.db.views[n]
                self._register(view.text, within | {n})
                df = dialect.query(self.spark, view.text)
                (df.toDF(*view.columns) if view.columns else df).createOrReplaceTempView(n)

    def _one(self, s: str, args: list | None) -> DataFrame | None:
        head = s.split(None, 1)[0].upper()
        if head in ("SELECT", "WITH", "(", "VALUES"):
            return self.query(s, args)
        plain = {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback}
        if head in plain:
            return plain[head]()
        act = getattr(self, f"_{head.lower()}", None)
        if act is None:
            raise ValueError(f"unknown statement {head}")
        return act(s)

    def _match(self, pattern: str, s: str) -> re.Match:
        m = re.fullmatch(pattern, s, re.I | re.S)
        if not m:
            raise ValueError(f"can't read: {s[:80]}")
        return m

    def _show(self, s: str) -> DataFrame:
        if re.fullmatch(r"(?i)show\s+tables", s):
            return self.db.meta("tables", self.visible())
        m = self._match(rf"show\s+columns\s+(?:from\s+)?({_NAME})", s)
        return self.db.meta("columns", {m[1].lower(): self.table(m[1])})

    def _create(self, s: str) -> None:
        if m := re.fullmatch(rf"(?is)create\s+view\s+({_NAME})\s*(?:\(([^)]*)\))?\s+as\s+(.+)", s):
            if m[1].lower() in self.db.views or m[1].lower() in self.visible():
                raise ValueError(f"{m[1]} exists")
            view = View(m[3], tuple(c.strip() for c in m[2].split(",")) if m[2] else ())
            found = self.query(m[3]).columns  # a view that can't be read is told at once
            if view.columns and len(view.columns) != len(found):
                raise ValueError(f"{m[1]} has {len(found)} columns")
            self.db.views[m[1].lower()] = view
            return
        m = self._match(rf"create\s+table\s+(if\s+not\s+exists\s+)?({_NAME})\s*(?:as\s+(.+)|\((.+)\))", s)
        name = m[2].lower()
        if name in self.visible():
            if m[1]:
                return
            raise ValueError(f"table {name} exists")
        if m[3]:
            self._set(name, self.query(m[3]))
            return
        columns, keys = [], []
        for item in split_top(m[4], ","):
            if k := re.match(r"(?i)(?:constraint\s+\w+\s+)?(primary\s+key|unique|foreign\s+key)\s*\(([^)]*)\)", item):
                keys.append((re.sub(r"\s+", " ", k[1].lower()), tuple(x.strip() for x in k[2].split(","))))
                continue
            c = self._match(rf"({_NAME})\s+(\w+)(?:\s*\([^)]*\))?(.*)", item)
            columns.append(f"{c[1]} {COLUMN_TYPES[c[2].lower()]}")
            for word in ("primary key", "unique"):
                if word in c[3].lower():
                    keys.append((word, (c[1],)))
        if keys:
            self.db.note("constraints", f"the constraints of {name} will not be enforced", logging.WARNING)
        self.db.constraints[name] = keys
        self._set(name, self.spark.createDataFrame([], ", ".join(columns)))

    def _drop(self, s: str) -> None:
        m = self._match(rf"drop\s+(table|view)\s+(if\s+exists\s+)?({_NAME})", s)
        name, known = m[3].lower(), self.visible() if m[1].lower() == "table" else self.db.views
        if name not in known:
            if m[2]:
                return
            raise KeyError(f"no {m[1].lower()} {name}")
        if m[1].lower() == "table":
            self._set(name, None)
        else:
            del self.db.views[name]

    def _insert(self, s: str) -> None:
        m = self._match(rf"insert\s+into\s+({_NAME})\s*(?:\(([^)]*)\)\s*)?(values\s*\(.+\)|select.+|with.+)", s)
        if m[1].lower().startswith("meta_"):
            return self._change_meta(m[1].lower(), "insert", [r for r in self.query(re.sub(r"(?is)^values", "SELECT * FROM VALUES", m[3])).collect()])
        old = self.table(m[1])
        names = [c.strip() for c in m[2].split(",")] if m[2] else old.columns
        rows = self.query(m[3] if not m[3].lower().startswith("values") else f"SELECT * FROM {m[3]}")
        if len(rows.columns) != len(names):
            raise ValueError(f"{len(names)} columns, but {len(rows.columns)} values")
        rows = rows.toDF(*names)
        cells = [(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields]
        self._write(m[1].lower(), old.unionAll(rows.select(*cells)))

    def _delete(self, s: str) -> None:
        m = self._match(rf"delete\s+from\s+({_NAME})(?:\s+where\s+(.+))?", s)
        if m[1].lower() == "meta_plugins":
            return self._change_meta("meta_plugins", "delete", self.query(f"SELECT * FROM meta_plugins WHERE {m[2] or 'true'}").collect())
        self._write(m[1].lower(), self.query(f"SELECT * FROM {m[1]} WHERE NOT coalesce(({m[2] or 'true'}), false)"))

    def _update(self, s: str) -> None:
        m = self._match(rf"update\s+({_NAME})\s+set\s+(.+?)(?:\s+where\s+(.+))?", s)
        sets = dict(self._match(rf"({_NAME})\s*=\s*(.+)", x).groups() for x in split_top(m[2], ","))
        if m[1].lower() == "meta_settings":
            for r in self.query(f"SELECT name FROM meta_settings WHERE {m[3] or 'true'}").collect():
                value = sets["value"].strip("'")
                self.db.settings[r[0]] = (value, self.db.settings.get(r[0], ("", ""))[1])
                if r[0].startswith("spark.sql."):
                    self.spark.conf.set(r[0], value)
            return None
        old = self.table(m[1])
        cells = [f"CAST(CASE WHEN ({m[3] or 'true'}) THEN {sets[f.name]} ELSE {f.name} END AS {f.dataType.simpleString()}) AS {f.name}" if f.name in sets else f.name for f in old.schema.fields]
        self._write(m[1].lower(), self.query(f"SELECT {', '.join(cells)} FROM {m[1]}"))

    def _change_meta(self, name: str, how: str, rows: list) -> None:
        for r in rows:
            if name == "meta_plugins" and how == "insert":
                if r[0] not in self.db.plugins:
                    raise KeyError(f"no plugin {r[0]}")
                self.db.loaded.add(r[0])
            elif name == "meta_plugins":
                self.db.loaded.discard(r[0])
            elif name == "meta_exec" and how == "insert":
                self.db.plugins[r[0]][r[1]]()
            else:
                raise ValueError(f"{name} can't be changed so")

    def _prepare(self, s: str) -> None:
        m = self._match(rf"prepare\s+({_NAME})\s+from\s+'(.+)'", s)
        self.db.prepared[m[1].lower()] = m[2].replace("''", "'")

    def _execute(self, s: str) -> DataFrame | None:
        m = self._match(rf"execute\s+({_NAME})\s*(?:\((.*)\))?", s)
        values = split_top(m[2] or "", ",")
        args = [self.spark.sql(f"SELECT {v}").first()[0] for v in values]
        return self._one(self.db.prepared[m[1].lower()], args)

    def _import(self, s: str) -> None:
        m = self._match(rf"import\s+from\s+(\w+)\s+file\s+'(.+)'\s+into\s+({_NAME})", s)
        self._load(m[3].lower(), m[2], m[1].lower())

    def _copy(self, s: str) -> None:
        m = self._match(rf"copy\s+({_NAME})\s+(from|to)\s+'(.+?)'(?:\s+with\s*\(?\s*(?:format\s+)?(\w+)\s*\)?)?(?:\s+encoding\s+'\w+')?", s)
        if m[2].lower() == "from":
            self._load(m[1].lower(), m[3], m[4])
        else:
            files.write_file(self.query(f"SELECT * FROM {m[1]}"), m[3], m[4] and m[4].lower())

    def _load(self, name: str, path: str, kind: str | None) -> None:
        df = files.read_file(self.spark, path, kind and kind.lower())
        self._set(name, self.visible()[name].unionAll(df) if name in self.visible() else df)

