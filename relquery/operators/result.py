"""Results: a lazy frame whose rows are collected once, when first asked for, with the facts of its page."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame, Row

from relquery.query import Query

#: How deep nested rows are converted; what lies deeper becomes None.
MAX_DEPTH = 20


def plain(value: Any, as_object: bool = False, depth: int = 0) -> Any:
    """Rows as dicts (or objects), at any depth up to MAX_DEPTH."""
    if depth > MAX_DEPTH:
        warnings.warn("rows are nested too deep", stacklevel=2)
        return None
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        made = {k: plain(v, as_object, depth + 1) for k, v in value.items()}
        return SimpleNamespace(**made) if as_object else made
    return [plain(v, as_object, depth + 1) for v in value] if isinstance(value, list) else value


class Result:
    def __init__(self, df: DataFrame, total: Callable[[], int] | None = None, page: int | None = None, per_page: int | None = None) -> None:
        self.df = df
        self._total, self._page, self._per_page = total, page, per_page
        self._found: int | None = None
        self._rows: list[dict] | None = None
        self._objects: list[Any] | None = None
        self._at = 0
        self._stream: Iterator[Row] | None = None

    # rows

    def result_array(self) -> list[dict]:
        if self._rows is None:
            self._rows = [plain(r) for r in self.df.collect()]
        return self._rows

    def result(self) -> list[Any]:
        if self._objects is None:
            self._objects = [plain(r, True) for r in self.result_array()]
        return self._objects

    def custom_result_object(self, make: Callable[..., Any]) -> list[Any]:
        """Rows as instances of a class: made without arguments, then given a field for each column."""
        out = []
        for r in self.result_array():
            one = make()
            for k, v in r.items():
                setattr(one, k, v)
            out.append(one)
        return out

    def row(self, index: int = 0) -> Any:
        rows = self.result()
        return rows[index] if 0 <= index < len(rows) else None

    def row_array(self, index: int = 0) -> dict | None:
        rows = self.result_array()
        return rows[index] if 0 <= index < len(rows) else None

    def value(self, column: str) -> Any:
        return (self.row_array() or {}).get(column)

    def pluck(self, path: str) -> list:
        """One column; a dotted path goes into nested rows and gives None where it leads nowhere."""

        def at(value: Any) -> Any:
            for part in path.split("."):
                value = value.get(part) if isinstance(value, dict) else None
            return value

        return [r[path] if path in r else at(r) for r in self.result_array()]

    def key_by(self, key: str | Callable[[Any], Any], as_array: bool = False) -> dict:
        """Rows by a column or a function's value. The last of equal keys wins; without key, the row's number."""
        out: dict = {}
        for n, (row, one) in enumerate(zip(self.result_array(), self.result(), strict=True)):
            k = key(one) if callable(key) else row.get(key)
            if k is None:
                warnings.warn(f"row {n} has no key", stacklevel=2)
                k = n
            out[k] = row if as_array else one
        return out

    # cursor

    def _of(self, index: int, kind: str) -> Any:
        return self.row_array(index) if kind == "array" else self.row(index)

    def first_row(self, kind: str = "object") -> Any:
        return self._of(0, kind)

    def last_row(self, kind: str = "object") -> Any:
        return self._of(max(0, self.num_rows() - 1), kind)

    def next_row(self, kind: str = "object") -> Any:
        self._at += self._at + 1 < self.num_rows()
        return self._of(self._at, kind)

    def previous_row(self, kind: str = "object") -> Any:
        self._at -= self._at > 0
        return self._of(self._at, kind)

    def data_seek(self, n: int = 0) -> bool:
        ok = 0 <= n < self.num_rows()
        self._at = n if ok else self._at
        return ok

    def set_row(self, key: str | dict, value: Any = None) -> None:
        for k, v in key.items() if isinstance(key, dict) else [(key, value)]:
            self.result_array()[self._at][k] = v
        self._objects = None

    def unbuffered_row(self, kind: str = "object") -> Any:
        """The next row, fetched a partition at a time and not kept; None after the last."""
        if self._stream is None:
            self._stream = self.df.toLocalIterator()
        row = next(self._stream, None)
        return None if row is None else plain(row, kind != "array")

    # facts

    def num_rows(self) -> int:
        return len(self.result_array())

    def num_fields(self) -> int:
        return len(self.df.columns)

    def list_fields(self) -> list[str]:
        return self.df.columns

    def field_data(self) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString()} for f in self.df.schema]

    def free_result(self) -> None:
        self.df.unpersist()
        self._rows = self._objects = self._stream = None

    # pages

    def found_rows(self) -> int | None:
        if self._found is None and self._total is not None:
            self._found = self._total()
        return self._found

    def current_page(self) -> int | None:
        return self._page

    def per_page(self) -> int | None:
        return self._per_page

    def last_page(self) -> int | None:
        return None if self._per_page is None else max(1, -(-(self.found_rows() or 0) // self._per_page))

    def has_more_pages(self) -> bool:
        return self._page is not None and self._page < self.last_page()

    def from_(self) -> int | None:
        return None if self._page is None or not self.found_rows() else (self._page - 1) * self._per_page + 1

    def to(self) -> int | None:
        return None if self._page is None or not self.found_rows() else min(self._page * self._per_page, self.found_rows())

    def to_pagination_array(self) -> dict:
        return {"data": self.result_array(), "total": self.found_rows(), "per_page": self.per_page(), "current_page": self.current_page(), "last_page": self.last_page(), "from": self.from_(), "to": self.to(), "has_more": self.has_more_pages()}


def run(query: Query) -> Result:
    """The query's result; its total, if asked for, is counted without limit and page when first read."""
    from relquery.plans.compiler import Compiler

    session = query.session
    began = time.perf_counter()
    compiler = Compiler(session)
    session.log(query)
    frame = session.remembered(session.last_query(), compiler.frame(query))
    total = (lambda: compiler.total(query, whole=True).count()) if query.s.count_rows else None
    explicit = query.s.limit is not None
    per_page, page = (None, None) if query.s.page is None or explicit else query.s.page
    session.seconds.append(time.perf_counter() - began)
    result = Result(frame, total, page, per_page)
    session.last_result = result
    return result
