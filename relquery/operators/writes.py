"""Writes over copy-on-write tables: each gives a name a new frame; a transaction swaps or drops the whole map.

With a store, the end of the outermost transaction, or a write outside of one, writes the changed tables
as new versions and makes them count at once; they are then read from there, so plans stay short. Without a
store nothing is written, and writes last as long as the session.

A row that a condition makes null is neither updated nor deleted. Tables have no
keys by themselves; ``add_key`` or ``key=`` names one. ``affected_rows`` counts rows
that the last write inserted or hit, when it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relquery.functions.names import InvalidArgument, column, is_table

if TYPE_CHECKING:
    from relquery.query import Query


class Raw(str):
    """An expression, where plain text would be a value."""


class Writes:
    """Part of Session; uses its ``tables`` and ``spark``."""

    def __init__(self) -> None:
        self._before: list[tuple] = []
        self._status, self._strict, self._off = True, True, False
        self._fields: dict[str, dict] = {}
        self._keys: list[tuple[str, bool]] = []
        self._affected: int | Callable[[], int] = 0
        self.last_result = None

    @property
    def affected_rows(self) -> int:
        if callable(self._affected):
            self._affected = self._affected()
        return self._affected

    def _put(self, name: str, frame: DataFrame) -> None:
        """A table's new rows; they last at once if no transaction is open."""
        self.tables[name] = frame
        if not self._before:
            if self.tables.store is not None:
                self.affected_rows  # noqa: B018  counted on the rows as they were
            self.tables.commit()

    # ------------------------------------------------------------ rows

    def _rows(self, name: str, rows: Sequence[Mapping[str, Any]], number: str = "") -> DataFrame:
        table = self.table(name)
        unknown = {k for r in rows for k in r} - set(table.columns)
        if unknown:
            raise InvalidArgument(f"{name} has no column {sorted(unknown)}")
        fields = [f for f in table.schema if any(f.name in r for r in rows)]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + ([T.StructField(number, T.LongType())] if number else []))
        values = [tuple(None if isinstance(r.get(f.name), Raw) else self._fit(r.get(f.name), f.dataType) for f in fields) + ((k,) if number else ()) for k, r in enumerate(rows, 1)]
        frame = self.spark.createDataFrame(values, schema)
        for f in fields:
            if any(isinstance(r.get(f.name), Raw) for r in rows):
                if len(rows) > 1:
                    raise InvalidArgument("an expression is for one row")
                frame = frame.withColumn(f.name, F.expr(rows[0][f.name]).cast(f.dataType))
        return frame

    @staticmethod
    def _fit(value: Any, kind: T.DataType) -> Any:
        if value is None:
            return None
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        return str(value) if isinstance(kind, T.StringType) else value

    def _numbered(self, name: str, frame: DataFrame, start: str) -> DataFrame:
        """With values for the auto-increment column that the rows lack. start: the column of their numbers, from 1."""
        auto = next((c for c, f in self.tables.facts.get(name, {}).items() if f.get("auto_increment")), None)
        if auto is None or auto in frame.columns:
            return frame.drop(start)
        last = self.table(name).agg(F.coalesce(F.max(auto), F.lit(0)).alias("__last"))
        return frame.join(F.broadcast(last)).withColumn(auto, (F.col("__last") + F.col(start)).cast(self.table(name).schema[auto].dataType)).drop(start, "__last")

    def insert(self, name: str, row: Mapping[str, Any]) -> bool:
        return self.insert_batch(name, [row]) == 1

    def insert_batch(self, name: str, rows: Sequence[Mapping[str, Any]]) -> int:
        """Appends rows; returns their number. All rows have the same columns."""
        rows = list(rows)
        if not rows:
            raise InvalidArgument("no rows to insert")
        if any(set(r) != set(rows[0]) for r in rows):
            raise InvalidArgument("the rows have different columns")
        new = self._numbered(name, self._rows(name, rows, "__n"), "__n")
        self._affected = len(rows)
        self._put(name, self.table(name).unionByName(new, allowMissingColumns=True).select(*self.table(name).columns))
        return len(rows)

    def insert_from(self, name: str, rows: DataFrame | Query) -> None:
        """Appends the rows of a frame or query; nothing is collected."""
        frame = rows if isinstance(rows, DataFrame) else rows.to_df()
        self._affected = frame.count
        self._put(name, self.table(name).unionByName(frame, allowMissingColumns=True).select(*self.table(name).columns))

    def replace(self, name: str, row: Mapping[str, Any], key: str | Sequence[str] | None = None) -> bool:
        """Takes the place of rows with the same key, or is appended."""
        return self._replace(name, self._rows(name, [row]), key)

    def _replace(self, name: str, new: DataFrame, key: str | Sequence[str] | None = None) -> bool:
        """Rows of ``new`` take the place of rows with the same key; of new ones with the same key, the last counts."""
        keys = [key] if isinstance(key, str) else list(key or [c for c, f in self.tables.facts.get(name, {}).items() if f.get("primary_key")] or [self.primary(name)])
        old = self.table(name)
        order = Window.partitionBy(*keys).orderBy(F.desc("__n"))
        new = new.withColumn("__n", F.monotonically_increasing_id())
        new = new.withColumn("__n", F.row_number().over(order)).where((F.col("__n") == 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).drop("__n")
        self._affected = new.count
        self._put(name, old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True).select(*old.columns))
        return True

    def _condition(self, name: str, where: Any) -> Query:
        """A query with the condition: a query's own, what a callback adds to one, a mapping or a text."""
        query = self.query_on(name)
        if isinstance(where, type(query)):
            query.s.where = where.s.where
        elif callable(where):
            where(query)
        else:
            query.where(where)
        return query

    def _matching(self, name: str, where: Any, order: Any = None) -> tuple[DataFrame, Column]:
        """The table and a condition on it."""
        from relquery.plans.compiler import Compiler

        query = self._condition(name, where)
        frame, scope = Compiler(self).body(self.query_on(name))
        frame, condition = Compiler(self).boolean(frame, scope, query.s.where.pruned())
        return frame, F.coalesce(condition, F.lit(False))

    def _limited(self, frame: DataFrame, hit: Column, limit: int | None) -> tuple[DataFrame, Column]:
        """At most ``limit`` of the rows hit: the first by all their columns, so that runs agree."""
        if limit is None:
            return frame, hit
        marked = frame.withColumn("__id", F.monotonically_increasing_id()).withColumn("__hit", hit)
        names = [c for c in frame.columns if not c.startswith("__")]
        chosen = marked.where("__hit").orderBy(*names, "__id").limit(limit).select(F.col("__id").alias("__chosen"))
        return marked.join(chosen, F.col("__id") == F.col("__chosen"), "left"), F.col("__chosen").isNotNull()

    def update(self, name: str, values: Mapping[str, Any], where: Any = None, limit: int | None = None) -> bool:
        if not values:
            raise InvalidArgument("nothing to set")
        table = self.table(name)
        frame, hit = (table.alias(name), F.lit(True)) if where is None else self._matching(name, where)
        frame, hit = self._limited(frame, hit, limit)
        kinds = {f.name: f.dataType for f in table.schema}
        unknown = set(values) - set(kinds)
        if unknown:
            raise InvalidArgument(f"{name} has no column {sorted(unknown)}")

        def new(c: str) -> Column:
            value = values[c]
            return F.when(hit, (F.expr(value) if isinstance(value, Raw) else F.lit(self._fit(value, kinds[c]))).cast(kinds[c])).otherwise(F.col(f"{name}.{c}" if limit is None else c)).alias(c)

        self._affected = frame.where(hit).count
        self._put(name, frame.select(*[new(c) if c in values else F.col(f"{name}.{c}" if limit is None else c) for c in table.columns]))
        return True

    def update_batch(self, name: str, rows: Sequence[Mapping[str, Any]], index: str, where: Any = None) -> int:
        """Sets, in rows with the same index, the columns each row gives. The last of rows with one index counts.
        Returns how many rows of the table had one of the indexes."""
        rows = list(rows)
        if not rows or any(index not in r for r in rows):
            raise InvalidArgument(f"each row needs {index!r}")
        table = self.table(name)
        kinds = {f.name: f.dataType for f in table.schema}
        changed = sorted({k for r in rows for k in r} - {index})
        merged: dict[Any, dict] = {}
        for r in rows:
            merged.setdefault(r[index], {}).update(r)
        schema = T.StructType([T.StructField("__index", kinds[index])] + [f for c in changed for f in (T.StructField(f"__{c}", kinds[c]), T.StructField(f"__has_{c}", T.BooleanType()))])
        values = [(self._fit(k, kinds[index]), *[x for c in changed for x in (self._fit(r.get(c), kinds[c]), c in r)]) for k, r in merged.items()]
        frame, hit = (table.alias(name), F.lit(True)) if where is None else self._matching(name, where)
        joined = frame.join(F.broadcast(self.spark.createDataFrame(values, schema)), F.col(f"{name}.{index}") == F.col("__index"), "left")  # rows given by the caller
        self._affected = joined.where(hit & F.col("__index").isNotNull()).count
        changes = self.affected_rows
        self._put(name, joined.select(*[F.when(hit & F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(f"{name}.{c}")).alias(c) if c in changed else F.col(f"{name}.{c}") for c in table.columns]))
        return changes

    def delete(self, name: str | Sequence[str], where: Any = None, limit: int | None = None) -> bool:
        if where is None:
            raise InvalidArgument("delete needs a condition; empty_table takes all rows out")
        for one in [name] if isinstance(name, str) else name:
            table = self.table(one)
            frame, hit = self._limited(*self._matching(one, where), limit)
            self._affected = frame.where(hit).count
            self._put(one, frame.where(~hit).select(*[F.col(f"{one}.{c}" if limit is None else c) for c in table.columns]))
        return True

    def empty_table(self, name: str) -> bool:
        self._affected = self.table(name).count
        self._put(name, self.spark.createDataFrame([], self.table(name).schema))
        return True

    truncate = empty_table

    # ------------------------------------------------------------ text of writes

    def insert_string(self, name: str, row: Mapping[str, Any]) -> str:
        return f"INSERT INTO {name} ({', '.join(row)}) VALUES ({', '.join(self.escape(v) if not isinstance(v, Raw) else v for v in row.values())})"

    def update_string(self, name: str, values: Mapping[str, Any], where: Any) -> str:
        if not where:
            raise InvalidArgument("update needs a condition")
        from relquery.plans.text import group_text

        query = self._condition(name, where)
        sets = ", ".join(f"{k} = {self.escape(v) if not isinstance(v, Raw) else v}" for k, v in values.items())
        return f"UPDATE {name} SET {sets} WHERE {group_text(query, query.s.where.pruned())}"

    def get_compiled_insert(self, name: str, row: Mapping[str, Any]) -> str:
        return self.insert_string(name, row)

    def get_compiled_update(self, name: str, values: Mapping[str, Any], where: Any) -> str:
        return self.update_string(name, values, where)

    def get_compiled_delete(self, name: str, where: Any) -> str:
        return self.update_string(name, {"x": 0}, where).replace(f"UPDATE {name} SET x = 0", f"DELETE FROM {name}", 1)

    def write_sql(self, sql: str) -> bool:
        """INSERT, REPLACE (by primary key), UPDATE ... SET and DELETE of registered tables; other statements go to Spark."""
        text = sql.strip().rstrip(";")
        if m := re.fullmatch(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", text):
            return self.delete(m[1], m[2]) if m[2] else self.empty_table(m[1])
        if m := re.fullmatch(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", text):
            from relquery.functions.names import split_list

            values = {k.strip(): Raw(v.strip()) for k, _, v in (s.partition("=") for s in split_list(m[2]))}
            return self.update(m[1], values, m[3])
        if m := re.fullmatch(r"(?is)(INSERT|REPLACE)\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES.*|SELECT.*)", text):
            kinds = {f.name: f.dataType for f in self.table(m[2]).schema}
            names = [c.strip() for c in m[3].split(",")] if m[3] else list(kinds)
            frame = self.spark.sql(m[4] if m[4][:6].upper() == "SELECT" else f"SELECT * FROM {m[4]}").toDF(*names)
            frame = frame.select(*[F.col(c).cast(kinds[c]) for c in names])
            if m[1].upper() == "REPLACE":
                return self._replace(m[2], frame)
            self.insert_from(m[2], frame)
            return True
        self.spark.sql(sql)
        return True

    # ------------------------------------------------------------ transactions

    def trans_begin(self) -> bool:
        if self._off:
            return False
        self._before.append(self.tables.saved())
        return True

    def _end(self, keep: bool) -> bool:
        if self._off or not self._before:
            return False
        before = self._before.pop()
        if not self._before:
            if keep:
                self.tables.commit()
            else:
                self.tables.restore(before)
        return True

    def trans_commit(self) -> bool:
        return self._end(True)

    def trans_rollback(self) -> bool:
        return self._end(False)

    def trans_start(self) -> bool:
        if not self._before:
            self._status = True
        return self.trans_begin()

    def trans_complete(self) -> bool:
        ok = self._status
        self._end(ok)
        if not self._strict and not self._before:
            self._status = True
        return ok

    def trans_fail(self) -> None:
        """Marks the transaction as failed, as an error in a query does."""
        self._status = False

    def trans_status(self) -> bool:
        return self._status

    def trans_active(self) -> bool:
        return bool(self._before)

    def trans_strict(self, on: bool = True) -> None:
        self._strict = bool(on)

    def trans_off(self) -> None:
        self._off = True

    def transaction(self, callback: Callable[[Any], Any], strict: bool = False) -> Any:
        """The callback's value, with its writes kept; on an error none is kept and False comes back, or the error."""
        if not callable(callback):
            raise InvalidArgument("a transaction needs a callback")
        depth, before = len(self._before), self.tables.saved()
        self.trans_begin()
        try:
            value = callback(self)
            del self._before[depth:]
            if not self._before:
                self.tables.commit()
        except Exception:
            del self._before[depth:]
            self.tables.restore(before)
            if strict:
                raise
            return False
        return value

    # ------------------------------------------------------------ tables

    def create_database(self, name: str) -> bool:
        self.spark.sql(f"CREATE DATABASE {self._name(name)}")
        return True

    def drop_database(self, name: str) -> bool:
        self.spark.sql(f"DROP DATABASE {self._name(name)}")
        return True

    @staticmethod
    def _name(name: str) -> str:
        if not is_table(name):
            raise InvalidArgument(f"invalid name: {name!r}")
        return name

    def add_field(self, fields: str | Mapping[str, Mapping[str, Any]]) -> None:
        """Columns of the table to be created; "id" alone is an auto-increment primary key."""
        if fields == "id":
            self._fields["id"] = {"type": "INT", "constraint": 9, "auto_increment": True}
            self.add_key("id", True)
        elif isinstance(fields, Mapping):
            self._fields |= {column(k): dict(v) for k, v in fields.items()}
        else:
            raise InvalidArgument("a column needs a description")

    def add_key(self, names: str | Sequence[str], primary: bool = False) -> None:
        self._keys += [(n, primary) for n in ([names] if isinstance(names, str) else names)]

    @staticmethod
    def _type(fact: Mapping[str, Any]) -> T.DataType:
        kind = str(fact.get("type", "VARCHAR")).upper().split("(")[0].split()[0]
        text = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "BLOB": "binary", "BOOLEAN": "boolean", "BOOL": "boolean"}.get(kind, "string")
        if kind in ("DECIMAL", "NUMERIC"):
            text = f"decimal({fact.get('constraint', '10,0')})"
        return T._parse_datatype_string(text)

    def create_table(self, name: str, if_not_exists: bool = False) -> bool:
        self._name(name)
        fields, keys = self._fields, self._keys
        self._fields, self._keys = {}, []
        if name in self.tables:
            if if_not_exists:
                return True
            raise InvalidArgument(f"{name} exists")
        if not fields:
            raise InvalidArgument("a table needs columns")
        self.tables.facts[name] = {k: f | {"primary_key": (k, True) in keys} for k, f in fields.items()}
        self._affected = 0
        self._put(name, self.spark.createDataFrame([], T.StructType([T.StructField(k, self._type(f), True) for k, f in fields.items()])))
        return True

    def drop_table(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.tables:
            if if_exists:
                return True
            raise InvalidArgument(f"no table is called {name!r}")
        del self.tables[name]
        self.spark.catalog.dropTempView(name)
        if not self._before:
            self.tables.commit()
        return True

    def rename_table(self, name: str, new: str) -> bool:
        self.tables.facts[self._name(new)] = self.tables.facts.get(name, {})
        frame = self.table(name)
        del self.tables[name]
        self._affected = 0
        self._put(new, frame)
        return True

    def add_column(self, name: str, fields: Mapping[str, Mapping[str, Any]]) -> bool:
        made = self.table(name).withColumns({column(k): F.lit(f.get("default")).cast(self._type(f)) for k, f in fields.items()})
        self.tables.facts.setdefault(name, {}).update({k: dict(f) for k, f in fields.items()})
        self._affected = 0
        self._put(name, made)
        return True

    def drop_column(self, name: str, field: str) -> bool:
        self._affected = 0
        self._put(name, self.table(name).drop(field))
        return True

    def modify_column(self, name: str, fields: Mapping[str, Mapping[str, Any]]) -> bool:
        """A new type, a new name, or both."""
        table = self.table(name)
        for k, f in fields.items():
            table = table.withColumn(k, F.col(k).cast(self._type(f))) if "type" in f else table
            table = table.withColumnRenamed(k, column(f["name"])) if f.get("name") else table
        self._affected = 0
        self._put(name, table)
        return True
