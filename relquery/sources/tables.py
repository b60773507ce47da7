"""Tables by name: registered frames, Parquet in a folder, or the session's catalog. Exports as text."""

from __future__ import annotations

import os
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from relquery.sources.store import Store


class Tables:
    """A map from names to frames; a write puts a new frame under a name."""

    def __init__(self, spark: SparkSession, known: dict[str, DataFrame], folder: str | None = None, store: Store | None = None) -> None:
        self.spark, self.known, self.folder, self.store = spark, known, folder, store
        self.facts: dict[str, dict[str, dict]] = {}  # what a schema can't hold: keys, defaults, lengths
        self.gone: set[str] = set()
        self.changed: set[str] = set()  # names that were written since the last commit
        if store is not None:
            self.facts |= store.state["facts"]

    def saved(self) -> tuple:
        """What a rollback goes back to."""
        return dict(self.known), {k: dict(v) for k, v in self.facts.items()}, set(self.gone), set(self.changed)

    def restore(self, saved: tuple) -> None:
        self.known, self.facts, self.gone, self.changed = saved

    def commit(self) -> None:
        """Makes what was written last, if there is a store."""
        if self.store is not None and self.changed:
            frames = {n: self.known[n] for n in sorted(self.changed - self.gone)}
            self.known |= self.store.commit(frames, self.changed & self.gone, self.facts)
        self.changed = set()

    def _path(self, name: str) -> str | None:
        return f"{self.folder}/{name}.parquet" if self.folder and name not in self.gone else None

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def __contains__(self, name: str) -> bool:
        return name in self.known or (self.store is not None and name not in self.gone and name in self.store.state["tables"]) or ((p := self._path(name)) is not None and self._exists(p)) or (name not in self.gone and self.spark.catalog.tableExists(name))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            path = self._path(name)
            if self.store is not None and name not in self.gone and name in self.store.state["tables"]:
                self.known[name] = self.store.read(name)
            elif path is not None and self._exists(path):
                self.known[name] = self.spark.read.parquet(path)
            else:
                return self.spark.table(name)
        return self.known[name]

    def __setitem__(self, name: str, frame: DataFrame) -> None:
        self.known[name] = frame
        self.gone.discard(name)
        self.changed.add(name)

    def __delitem__(self, name: str) -> None:
        self.known.pop(name, None)
        self.facts.pop(name, None)
        self.gone.add(name)
        self.changed.add(name)

    def names(self) -> list[str]:
        found = set(self.known) | (set(self.store.names()) - self.gone if self.store is not None else set())
        if self.folder and "://" not in self.folder and os.path.isdir(self.folder):
            found |= {f.removesuffix(".parquet") for f in os.listdir(self.folder) if f.endswith(".parquet")} - self.gone
        return sorted(found)

    def describe(self, name: str) -> list[dict[str, Any]]:
        facts = self.facts.get(name, {})
        return [
            {"name": f.name, "type": f.dataType.simpleString(), "max_length": facts.get(f.name, {}).get("constraint"), "default": facts.get(f.name, {}).get("default"), "primary_key": int(bool(facts.get(f.name, {}).get("primary_key")))}
            for f in self[name].schema
        ]


def csv_text(frame: DataFrame, delimiter: str = ",", newline: str = "\n", enclosure: str = '"') -> str:
    """A small result as CSV: every value quoted, quotes doubled. Large ones: write_csv."""

    def quoted(v: Any) -> str:
        return enclosure + ("" if v is None else str(v)).replace(enclosure, enclosure * 2) + enclosure

    lines = [frame.columns, *frame.toLocalIterator()]
    return "".join(delimiter.join(map(quoted, line)) + newline for line in lines)


def write_csv(frame: DataFrame, path: str, delimiter: str = ",") -> None:
    frame.write.csv(path, header=True, quoteAll=True, sep=delimiter, escape='"')


def xml_text(frame: DataFrame, root: str = "root", element: str = "element", newline: str = "\n", tab: str = "\t") -> str:
    """A small result as XML. Large ones: write_xml."""
    out = [f"<{root}>"]
    for row in frame.toLocalIterator():
        out.append(f"{tab}<{element}>")
        out += [f"{tab * 2}<{k}>{escape('' if v is None else str(v))}</{k}>" for k, v in row.asDict().items()]
        out.append(f"{tab}</{element}>")
    return newline.join([*out, f"</{root}>", ""])


def write_xml(frame: DataFrame, path: str, root: str = "root", element: str = "element") -> None:
    frame.write.format("xml").option("rootTag", root).option("rowTag", element).save(path)


def sql_text(tables: Tables, names: list[str] | None = None, drop: bool = True, rows: bool = True, newline: str = "\n") -> str:
    """Small tables as SQL statements: DROP, CREATE and an INSERT for each row. Large ones: backup."""

    def value(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(int(v))
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "''") + "'"

    out: list[str] = []
    for name in names or tables.names():
        frame = tables[name]
        out += [f"DROP TABLE IF EXISTS {name};"] if drop else []
        out.append(f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.dataType.simpleString().upper()}' for f in frame.schema)});")
        if rows:
            out += [f"INSERT INTO {name} ({', '.join(frame.columns)}) VALUES ({', '.join(map(value, row))});" for row in frame.toLocalIterator()]
    return newline.join([*out, ""])


def backup(tables: Tables, path: str, names: list[str] | None = None) -> list[str]:
    """Writes tables as Parquet under a folder."""
    names = names or tables.names()
    for name in names:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return names
