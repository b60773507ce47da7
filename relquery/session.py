"""A session: where tables come from, raw SQL, the log of queries, result caching and writes."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from relquery.functions import names as nm
from relquery.functions.names import InvalidArgument
from relquery.operators.writes import Writes
from relquery.query import Query, Source
from relquery.sources.store import Store
from relquery.sources.tables import Tables

# First words of statements that write.
WRITE_WORDS = "SET INSERT UPDATE DELETE REPLACE CREATE DROP TRUNCATE LOAD COPY ALTER RENAME GRANT REVOKE LOCK UNLOCK REINDEX MERGE".split()
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", re.S)


class Session(Writes):
    """``tables`` maps names to DataFrames; other names are looked for in ``store`` (a folder whose tables this session
    also writes), in ``folder`` (as Parquet, only read) and in the catalog. Without a store, writes last as long as the session."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, folder: str | None = None, prefix: str = "", store: str | None = None) -> None:
        self.spark = spark
        self.tables = Tables(spark, dict(tables or {}), folder, None if store is None else Store(spark, store))
        self.prefix = prefix
        self.queries: list[str] = []
        self.seconds: list[float] = []
        self._cached: dict[str, DataFrame] | None = None
        self._held: list[DataFrame] = []
        Writes.__init__(self)

    # ------------------------------------------------------------ queries

    def query_on(self, *given: Any) -> Query:
        """A new query on the tables."""
        return Query(self).from_(*given) if given else Query(self)

    table_query = query_on

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def prefixed(self, name: str) -> str:
        return name if not self.prefix or name.startswith(self.prefix) else self.prefix + name

    dbprefix = prefixed

    def set_dbprefix(self, prefix: str) -> str:
        self.prefix = prefix
        return prefix

    @staticmethod
    def is_write_type(sql: str) -> bool:
        first = re.match(r"\s*\"?(\w+)\s", sql)
        return first is not None and first[1].upper() in WRITE_WORDS

    def compile_binds(self, sql: str, binds: Any) -> str:
        """The text with ? replaced by quoted values; unchanged if their number differs."""
        values = list(binds) if isinstance(binds, (list, tuple)) else [binds]
        parts = re.split(r"('(?:[^']|'')*')", sql)
        if sum(p.count("?") for p in parts[::2]) != len(values):
            return sql
        rest = iter(values)
        return "".join(p if k % 2 else re.sub(r"\?", lambda _: self.escape(next(rest)), p) for k, p in enumerate(parts))

    def escape(self, value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(int(value))
        if isinstance(value, (int, float)):
            return repr(value)
        if isinstance(value, (list, tuple)):
            return "(" + ",".join(map(self.escape, value)) + ")"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    @staticmethod
    def escape_like_str(text: str) -> str:
        return re.sub(r"([!%_])", r"!\1", text)

    def query(self, sql: str, binds: Any = None, relations: Query | None = None) -> Any:
        """Raw SQL. Rows become a Result, with the relations of the query given; a write returns True."""
        from relquery.operators.result import Result

        text = sql if binds is None else self.compile_binds(sql, binds)
        began = time.perf_counter()
        self.queries.append(text)
        words = set(re.findall(r"\w+", _LITERAL.sub(" ", text)))
        for name in self.tables.names():
            if name in words:
                self.tables[name].createOrReplaceTempView(name)
        if self.is_write_type(text):
            done = self.write_sql(text)
            self.seconds.append(time.perf_counter() - began)
            return done
        frame = self.spark.sql(text)
        if relations is not None:
            outer = Query(self)
            outer.s.sources = [Source(frame, "q")]
            outer.s.relations = list(relations.s.relations)
            frame = outer.to_df()
        self.seconds.append(time.perf_counter() - began)
        return Result(self.remembered(text, frame))

    # ------------------------------------------------------------ log and cache

    def log(self, query: Query) -> None:
        from relquery.plans.text import select_text

        self.queries.append(select_text(query))

    def last_query(self) -> str | None:
        return self.queries[-1] if self.queries else None

    def all_last_query(self) -> list[str]:
        return list(self.queries)

    def total_queries(self) -> int:
        return len(self.queries)

    def elapsed_time(self, decimals: int = 6) -> float:
        return round(sum(self.seconds), decimals)

    def cache_on(self) -> None:
        self._cached = {} if self._cached is None else self._cached

    def cache_off(self) -> None:
        self.cache_delete()
        self._cached = None

    def cache_delete(self) -> None:
        for frame in (self._cached or {}).values():
            frame.unpersist()
        if self._cached is not None:
            self._cached = {}

    def held(self, frame: DataFrame) -> DataFrame:
        """A page that several reads share: kept by executors from its first read on, until ``release``."""
        self._held.append(frame.persist())
        return self._held[-1]

    def release(self) -> None:
        """Frees the pages that were kept for relations."""
        for frame in self._held:
            frame.unpersist()
        self._held = []

    def get_found_rows(self) -> int | None:
        """The total of the last query that counted its rows."""
        return self.last_result.found_rows() if self.last_result is not None else None

    def protect_identifiers(self, name: str) -> str:
        """A name, perhaps with table and alias, in backquotes and with the prefix where a table is named."""
        return nm.protected(name, self.prefixed)

    def remembered(self, text: str, frame: DataFrame) -> DataFrame:
        """With the cache on, the persisted frame of the same text."""
        if self._cached is None:
            return frame
        if text not in self._cached:
            self._cached[text] = frame.persist()
        return self._cached[text]

    # ------------------------------------------------------------ catalog

    def list_tables(self) -> list[str]:
        return self.tables.names()

    def table_exists(self, name: str) -> bool:
        return name in self.tables

    def list_fields(self, name: str) -> list[str]:
        return self.table(name).columns

    def field_exists(self, field: str, name: str) -> bool:
        return field in self.table(name).columns

    def field_data(self, name: str) -> list[dict]:
        return self.tables.describe(name)

    def primary(self, name: str) -> str:
        return self.table(name).columns[0]

    def count_all(self, name: str) -> int:
        return self.table(name).count()

    def list_databases(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def database_exists(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def need(self, name: str) -> None:
        if name not in self.tables:
            raise InvalidArgument(f"no table is called {name!r}")

    def call(self, callback: Callable[[Session], Any]) -> Any:
        return callback(self)
