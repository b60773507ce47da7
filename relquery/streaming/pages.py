"""Rows in pages for a callback, so that a large result never stands on the driver at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from relquery.functions.names import InvalidArgument, bare
from relquery.operators.result import plain

if TYPE_CHECKING:
    from relquery.query import Query


def chunk(query: Query, size: int, callback: Callable[[list], Any]) -> int:
    """Calls back with lists of ``size`` rows; False stops. Returns the rows of the pages before the stop.

    One pass over one ordered result, a partition at a time: no page is found by skipping rows.
    """
    if size < 1:
        raise InvalidArgument("a page has one row at least")
    frame = query.to_df()
    if not query.s.orders:
        frame = frame.orderBy(*[F.col(f"`{f.name}`") for f in frame.schema if f.dataType.typeName() not in ("map", "variant")])
    done, page = 0, []
    for row in frame.toLocalIterator(prefetchPartitions=True):
        page.append(plain(row, True))
        if len(page) == size:
            if callback(page) is False:
                return done
            done, page = done + size, []
    if page and callback(page) is not False:
        done += len(page)
    return done


def chunk_by_id(query: Query, size: int, callback: Callable[[list], Any], column: str = "id") -> int:
    """Pages by a key: each begins above the last key of the one before, so rows that share that key are not given again.

    One pass over the rows in order of the key, a partition at a time; no page scans the table anew. Rows
    without a key come first and only on the first page.
    """
    if size < 1:
        raise InvalidArgument("a page has one row at least")
    base = query.copy()
    base.s.orders, base.s.limit, base.s.offset = [], None, 0
    frame, name = base.order_by(column, "ASC").to_df(), bare(column)
    if name not in frame.columns:
        raise InvalidArgument(f"the rows have no column {name!r}")
    done, page, first, last = 0, [], True, None
    for row in frame.toLocalIterator(prefetchPartitions=True):
        key = row[name]
        if not first and (key is None or (last is not None and key <= last)):
            continue
        page.append(plain(row, True))
        if len(page) == size:
            if callback(page) is False:
                return done
            done, page, first, last = done + size, [], False, key
    if page and callback(page) is not False:
        done += len(page)
    return done
