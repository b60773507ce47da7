"""From queries to DataFrames.

Related rows never become correlated sub-queries: they are aggregated by their
foreign keys and joined once, so every predicate and aggregate is one scan and one
equi-join that Catalyst may broadcast or shuffle. Existence under AND alone is a
left semi or anti join. A sub-query that names columns of an outer query other than by
its keys is joined with the distinct values of those columns first.

Columns made on the way start with two underscores and never reach a result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relquery.functions import expressions as ex
from relquery.functions import names as nm
from relquery.functions.names import InvalidArgument
from relquery.plans import predicates as pr
from relquery.query import Aggregate, Item, Order, Query, Relation, Source

if TYPE_CHECKING:
    from relquery.session import Session

_counter = itertools.count()
#: Longer lists of values are joined rather than written into the plan.
LONG_LIST = 10_000
#: The keys of a page of at most so many rows are broadcast to the scans of its relations; those of longer ones are joined.
PAGE_ROWS = 10_000


def _hidden(what: str) -> str:
    return f"__{what}{next(_counter)}"


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


class Scope:
    """What names mean in a frame. outer: columns of outer queries that the frame carries under hidden names."""

    def __init__(self, main: str, aliases: set[str], outer: dict[tuple[str, str], str]) -> None:
        self.main, self.aliases = main, aliases
        self.outer = {k: v for k, v in outer.items() if k[0] not in aliases}
        self.made: dict[int, str] = {}  # aggregates by identity

    def col(self, name: str) -> Column:
        qualifier, _, column = name.rpartition(".")
        return F.col(f"`{self.outer[qualifier, column]}`") if (qualifier, column) in self.outer else F.col(name)

    def local(self, name: str) -> Column:
        return self.col(name if "." in name else f"{self.main}.{name}")

    def expr(self, text: str) -> Column:
        return self.col(text) if nm.is_column(text) else F.expr(pr.replace_dotted(text, self.outer))


def compared(left: Column, op: str, right: Column | Any) -> Column:
    return {"=": left.__eq__, "!=": left.__ne__, "<>": left.__ne__, ">": left.__gt__, "<": left.__lt__, ">=": left.__ge__, "<=": left.__le__}[op](right)


def matched(frame: DataFrame, column: Column, value: Any) -> tuple[Column, Any]:
    """Column and literal of types that compare as a weakly typed database would."""
    kind = frame.select(column).schema[0].dataType
    if isinstance(kind, T.BooleanType) and isinstance(value, (int, float, str)) and not isinstance(value, bool):
        return column.cast("int"), F.lit(value).try_cast("int") if isinstance(value, str) else value
    if isinstance(value, bool) and not isinstance(kind, T.BooleanType):
        value = int(value)
    if isinstance(kind, T.NumericType) and isinstance(value, str):
        return column, F.lit(value).try_cast("double")
    if isinstance(kind, T.StringType) and isinstance(value, (int, float)):
        return column.try_cast("double"), value
    return column, value


def like_pattern(term: str, side: str) -> str:
    body = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return {"none": body, "before": f"%{body}", "after": f"{body}%"}.get(side, f"%{body}%")


class Compiler:
    def __init__(self, session: Session) -> None:
        self.session = session

    # ------------------------------------------------------------ rows

    def source(self, given: Source) -> DataFrame:
        frame = given.source
        if isinstance(frame, Query):
            frame = self.frame(frame)
        elif isinstance(frame, str):
            frame = self.session.table(frame)
        return frame.alias(given.alias)

    @staticmethod
    def aliases(query: Query) -> set[str]:
        return {s.alias for s in query.s.sources} | {j.source.alias for j in query.s.joins}

    def outer_names(self, query: Query) -> set[tuple[str, str]]:
        """Columns of outer queries that a query names, by itself or further down."""
        own, found = self.aliases(query), set()
        for j in query.s.joins:
            found |= pr.dotted(j.on)
        for node in [*query.s.where.walk(), *query.s.having.walk()]:
            if isinstance(node, pr.Raw):
                found |= pr.dotted(node.text)
            elif isinstance(node, (pr.Compare, pr.In, pr.Between, pr.Like)):
                found |= pr.dotted(node.key)
            elif isinstance(node, (pr.Exists, pr.Has)):
                found |= self.outer_names(node.sub) | {n for k in node.local for n in pr.dotted(k)}
        for a in [*query.s.aggregates, *query.s.relations]:
            found |= self.outer_names(a.sub) | {n for k in a.local for n in pr.dotted(k)}
        return {n for n in found if n[0] not in own}

    def body(self, query: Query, start: tuple[DataFrame, list[tuple[str, str]]] | None = None, outer: dict | None = None, wanted: list[Aggregate] | None = None) -> tuple[DataFrame, Scope]:
        """Sources, joins, aggregates of related rows and filters. start: a frame to join the first source to,
        with pairs of its columns and the source's."""
        s = query.s
        frames = [self.source(x) for x in s.sources]
        main = query.alias
        frame = frames[0]
        if start is not None:
            domain, pairs = start
            frame = domain.join(frame, _all([F.col(f"`{h}`") == F.col(f"{main}.{c}") for h, c in pairs])) if pairs else domain.crossJoin(frame)
        for other in frames[1:]:
            frame = frame.crossJoin(other)
        scope = Scope(main, self.aliases(query), outer or {})
        for j in s.joins:
            other = self.source(j.source)
            using = nm.split_list(j.on)
            frame = frame.join(other, [nm.bare(c) for c in using], j.how) if all(map(nm.is_column, using)) else frame.join(other, scope.expr(j.on), j.how)
        used = {id(n.aggregate) for n in s.where.walk() if isinstance(n, pr.OnAggregate)}
        frame = self.with_aggregates(frame, scope, [a for a in s.aggregates if wanted is None or id(a) in used or any(a is w for w in wanted)])
        return self.filtered(frame, scope, s.where), scope

    def filtered(self, frame: DataFrame, scope: Scope, group: pr.Group) -> DataFrame:
        group = group.pruned()
        if not group.items:
            return frame
        ways = group.alternatives()
        if len(ways) > 1 or group.negated:
            frame, condition = self.boolean(frame, scope, group)
            return frame.where(condition)
        for node in ways[0]:
            if isinstance(node, pr.Group) and not node.negated and len(node.alternatives()) == 1:
                frame = self.filtered(frame, scope, node)
            elif isinstance(node, pr.Exists) and node.foreign and not self.outer_names(node.sub):
                rows, inner = self.related(node.sub)
                names = [_hidden("k") for _ in node.foreign]
                right = rows.select(*[inner.local(f).alias(n) for f, n in zip(node.foreign, names, strict=True)])
                frame = frame.join(right, _all([scope.local(l) == F.col(f"`{n}`") for l, n in zip(node.local, names, strict=True)]), "left_anti" if node.negated else "left_semi")
            else:
                frame, condition = self.boolean(frame, scope, node)
                frame = frame.where(condition)
        return frame

    def boolean(self, frame: DataFrame, scope: Scope, node: Any) -> tuple[DataFrame, Column]:
        """A node as a column, on the frame with what the column needs."""
        if isinstance(node, pr.Group):
            ways = []
            for nodes in node.alternatives():
                parts = []
                for n in nodes:
                    frame, c = self.boolean(frame, scope, n)
                    parts.append(c)
                ways.append(_all(parts))
            out = reduce(lambda a, b: a | b, ways)
            return frame, ~out if node.negated else out
        if isinstance(node, pr.Exists):
            frame, got = self.attach(frame, scope, node.sub, node.foreign, node.local, {"found": lambda _: F.lit(True)}, distinct=True)
            flag = F.coalesce(F.col(f"`{got['found']}`"), F.lit(False))
            return frame, ~flag if node.negated else flag
        if isinstance(node, pr.Has):
            frame, got = self.attach(frame, scope, node.sub, node.foreign, node.local, {"n": lambda _: F.count(F.lit(1))})
            return frame, compared(F.coalesce(F.col(f"`{got['n']}`"), F.lit(0)), node.op, node.count)
        if isinstance(node, pr.OnAggregate):
            value = F.coalesce(F.col(f"`{scope.made[id(node.aggregate)]}`"), F.lit(0))
            if "BETWEEN" in node.op:
                out = value.between(*node.value)
                return frame, ~out if node.op.startswith("NOT") else out
            return frame, compared(value, node.op, node.value)
        if isinstance(node, pr.In) and len(node.values) > LONG_LIST:
            return self.in_long_list(frame, scope, node)
        return frame, self.simple(frame, scope, node)

    def simple(self, frame: DataFrame, scope: Scope, node: Any) -> Column:
        if isinstance(node, pr.Raw):
            return scope.expr(node.text)
        column = scope.expr(node.key)
        if isinstance(node, pr.Compare):
            if node.op == "IS NULL":
                return column.isNull()
            if node.op == "IS NOT NULL":
                return column.isNotNull()
            if node.op in ("LIKE", "NOT LIKE"):
                out = column.cast("string").ilike(str(node.value))
                return ~out if node.op == "NOT LIKE" else out
            if node.value is None:
                return F.lit(None).cast("boolean")
            left, right = matched(frame, column, node.value)
            return left.eqNullSafe(right) if node.op == "<=>" else compared(left, node.op, right)
        if isinstance(node, pr.In):
            if not node.values:
                return F.lit(node.negated)
            pairs = [matched(frame, column, v) for v in node.values]
            lefts = {str(l) for l, _ in pairs}
            out = pairs[0][0].isin([r for _, r in pairs]) if len(lefts) == 1 and not any(isinstance(r, Column) for _, r in pairs) else reduce(lambda a, b: a | b, [l == r for l, r in pairs])
            return ~out if node.negated else out
        if isinstance(node, pr.Between):
            (a, low), (b, high) = matched(frame, column, node.low), matched(frame, column, node.high)
            out = (a >= low) & (b <= high)
            return ~out if node.negated else out
        if isinstance(node, pr.Like):
            out = column.cast("string").ilike(like_pattern(node.term, node.side))
            return ~out if node.negated else out
        raise TypeError(type(node))

    def in_long_list(self, frame: DataFrame, scope: Scope, node: pr.In) -> tuple[DataFrame, Column]:
        """As ``simple`` does for a short list: values of one type are joined together, by the rule for that type."""
        column = scope.expr(node.key)
        kind = frame.select(column).schema[0].dataType
        kinds: dict[type, list] = {}
        for v in node.values:
            if v is not None:
                v = int(v) if isinstance(v, bool) and not isinstance(kind, T.BooleanType) else v
                kinds.setdefault(type(v), []).append(v)
        unknown = any(v is None for v in node.values)
        flags = []
        for values in kinds.values():
            left, _ = matched(frame, column, values[0])
            name, flag, key = _hidden("v"), _hidden("found"), _hidden("l")
            right = self.session.spark.createDataFrame([(v,) for v in values], [name])
            if isinstance(values[0], str) and isinstance(kind, (T.NumericType, T.BooleanType)):  # as ``matched`` casts a literal
                right = right.select(F.col(name).try_cast("double" if isinstance(kind, T.NumericType) else "int").alias(name))
            unknown_here = right.where(F.col(name).isNull()).limit(1).count() > 0
            unknown = unknown or unknown_here
            right = right.where(F.col(name).isNotNull()).distinct().withColumn(flag, F.lit(True))
            frame = frame.withColumn(key, left)
            frame = frame.join(right, F.col(key) == F.col(name), "left")
            flags.append((F.col(flag), F.col(key)))
        # as in SQL: true if found, unknown if the column or a value is null, else false
        found = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f, _ in flags], F.lit(False))
        blank = F.lit(unknown) | reduce(lambda a, b: a | b, [k.isNull() for _, k in flags], F.lit(False)) | column.isNull()
        out = F.when(found, F.lit(True)).when(blank, F.lit(None).cast("boolean")).otherwise(F.lit(False))
        return frame, ~out if node.negated else out

    # ------------------------------------------------------------ related rows

    def related(self, sub: Query, start: Any = None, outer: dict | None = None) -> tuple[DataFrame, Scope]:
        """The rows a sub-query selects, before its projection."""
        if sub.s.groups or sub.s.having.items or sub.s.limit is not None or sub.s.distinct:
            frame, scope, _, _ = self.shaped(sub, None, start, outer, ordered=sub.s.limit is not None)
            return frame, scope
        return self.body(sub, start, outer, wanted=[])

    def attach(self, frame: DataFrame, scope: Scope, sub: Query, foreign: list[str], local: list[str], made: dict[str, Callable[[Scope], Column]], distinct: bool = False) -> tuple[DataFrame, dict[str, str]]:
        """Joins, by the keys, aggregates of the sub-query's rows. Returns their hidden names."""
        got = {name: _hidden(name) for name in made}
        keys = [_hidden("k") for _ in foreign]
        outer = sorted(self.outer_names(sub))
        if not foreign and not outer:  # nothing ties the rows together
            rows, inner = self.related(sub)
            right = rows.limit(1).select(F.lit(True).alias(got["found"])) if distinct else rows.agg(*[f(inner).alias(got[n]) for n, f in made.items()])
            return frame.join(F.broadcast(right), F.lit(True), "left"), got
        if not outer:
            rows, inner = self.related(sub)
            named = [inner.local(f).alias(k) for f, k in zip(foreign, keys, strict=True)]
            right = rows.select(*named).distinct().withColumn(got["found"], F.lit(True)) if distinct else rows.groupBy(*named).agg(*[f(inner).alias(got[n]) for n, f in made.items()])
            return frame.join(right, _all([scope.local(l) == F.col(f"`{k}`") for l, k in zip(local, keys, strict=True)]), "left"), got
        names = {n: _hidden("o") for n in outer}
        domain = frame.select(*[scope.local(l).alias(k) for l, k in zip(local, keys, strict=True)], *[scope.col(".".join(n)).alias(h) for n, h in names.items()]).distinct()
        rows, inner = self.related(sub, (domain, list(zip(keys, foreign, strict=True))), names)
        every = [*keys, *names.values()]
        ends = {k: _hidden("j") for k in every}
        named = [F.col(f"`{k}`").alias(e) for k, e in ends.items()]
        right = rows.select(*named).distinct().withColumn(got["found"], F.lit(True)) if distinct else rows.groupBy(*named).agg(*[f(inner).alias(got[n]) for n, f in made.items()])
        on = [scope.local(l) == F.col(f"`{ends[k]}`") for l, k in zip(local, keys, strict=True)] + [scope.col(".".join(n)).eqNullSafe(F.col(f"`{ends[h]}`")) for n, h in names.items()]
        return frame.join(right, _all(on), "left"), got

    def with_aggregates(self, frame: DataFrame, scope: Scope, wanted: list[Aggregate]) -> DataFrame:
        """Adds the aggregates under hidden names; those over the same rows share one scan and join."""
        sets: dict[Any, list[Aggregate]] = {}
        for a in wanted:
            sets.setdefault(a.shared or id(a), []).append(a)
        for same in sets.values():
            made: dict[str, Callable[[Scope], Column]] = {f"a{k}_": self.aggregate(a) for k, a in enumerate(same)}
            frame, got = self.attach(frame, scope, same[0].sub, same[0].foreign, same[0].local, made | {"rows": lambda _: F.count(F.lit(1))})
            for k, a in enumerate(same):
                name = got[f"a{k}_"]
                if not a.joined and a.kind == "count":
                    frame = frame.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0)))
                elif not a.joined and a.kind == "calculation" and ex.has_aggregate(a.text):
                    rows, inner = self.related(Query.copy(self._plain(a.sub)))
                    empty = rows.where(F.lit(False)).agg(inner.expr(a.text).alias(_hidden("e")))
                    frame = frame.join(F.broadcast(empty), F.lit(True), "left")  # one row
                    frame = frame.withColumn(name, F.when(F.col(f"`{got['rows']}`").isNull(), F.col(empty.columns[0])).otherwise(F.col(f"`{name}`")))
                scope.made[id(a)] = name
        return frame

    def _plain(self, sub: Query) -> Query:
        """The sub-query without filters, for the value over no rows."""
        out = Query(self.session)
        out.s.sources = sub.s.sources
        return out

    @staticmethod
    def aggregate(a: Aggregate) -> Callable[[Scope], Column]:
        if a.kind == "count":
            return lambda _: F.count(F.lit(1))
        if a.kind == "calculation":
            if ex.has_aggregate(a.text):
                return lambda inner: inner.expr(a.text)
            message = F.lit(f"more than one row for {a.alias}")
            return lambda inner: F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(F.first(inner.expr(a.text)))
        call = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.kind]
        return lambda inner: call(inner.expr(a.text))

    # ------------------------------------------------------------ projection, order, pages

    def orders(self, frame: DataFrame, scope: Scope, orders: list[Order], named: dict[str, Column]) -> tuple[DataFrame, list[Column]]:
        out = []
        for o in orders:
            if o.kind == "random":
                out.append(F.rand(o.more))
                continue
            if o.kind == "relation":
                sub, foreign, local = o.more
                pick = F.max if o.descending else F.min
                frame, got = self.attach(frame, scope, sub, foreign, local, {"s": lambda inner, o=o, pick=pick: pick(inner.local(o.text))})
                column = F.col(f"`{got['s']}`")
            else:
                column = named[o.text] if o.text in named else scope.expr(o.text)
            if o.kind == "sequence":
                place = F.lit(len(o.more))
                for k in range(len(o.more) - 1, -1, -1):
                    left, right = matched(frame, column, o.more[k])
                    place = F.when(left == right, F.lit(k)).otherwise(place)
                column = place
            out.append(column.desc() if o.descending else column.asc())
        return frame, out

    def items(self, query: Query) -> list[Item]:
        if query.s.items:
            return query.s.items
        return [Item(f"{query.alias}.*")] if query.s.aggregates and all(a.joined for a in query.s.aggregates) and query.s.joins == [] else [Item("*")]

    def columns(self, query: Query, scope: Scope) -> list[Column]:
        out: list[Column] = []
        for item in self.items(query):
            if item.text == "*":
                out += [F.col(f"{s.alias}.*") for s in [*query.s.sources, *(j.source for j in query.s.joins)]]
            else:
                column = F.col(item.text) if item.text.endswith(".*") else scope.expr(item.text)
                out.append(column.alias(item.alias) if item.alias else column)
        return out + [F.col(f"`{scope.made[id(a)]}`").alias(a.alias) for a in query.s.aggregates if id(a) in scope.made]

    def page(self, frame: DataFrame, query: Query) -> DataFrame:
        limit, offset = query.s.limit, query.s.offset
        if query.s.page and limit is None:
            limit, offset = query.s.page[0], query.s.page[0] * (query.s.page[1] - 1)
        frame = frame.offset(offset) if offset else frame
        return frame if limit is None else frame.limit(limit)

    def shaped(self, query: Query, extras: Callable[[DataFrame, Scope], list[Column]] | None, start: Any = None, outer: dict | None = None, ordered: bool = True, restrict: Callable[[DataFrame, Scope], DataFrame] | None = None, paged: bool = True) -> tuple[DataFrame, Scope, list[Column] | None, list[Column]]:
        """The query's rows filtered, grouped, ordered and cut; still to be projected to the columns returned
        (None: projected already), and the columns of its order."""
        s = query.s
        grouped = bool(s.groups) or any(ex.has_aggregate(i.text) for i in s.items)
        frame, scope = self.body(query, start, outer)
        if restrict:
            frame = restrict(frame, scope)
        carried = [k for k in frame.columns if k.startswith(("__k", "__o"))] if start is not None else []
        if grouped:
            return self.grouped(query, frame, scope, carried, ordered, paged)
        named = {i.alias: scope.expr(i.text) for i in s.items if i.alias}
        named |= {a.alias: F.col(f"`{scope.made[id(a)]}`") for a in s.aggregates if id(a) in scope.made}
        if s.distinct:
            frame = frame.select(*self.columns(query, scope), *(extras(frame, scope) if extras else []), *carried).distinct()
            frame, order = self.orders(frame, scope, s.orders, {c: F.col(f"`{c}`") for c in frame.columns})
            frame = frame.orderBy(*order) if order and ordered else frame
            return (self.page(frame, query) if paged else frame), scope, None, order
        frame, order = self.orders(frame, scope, s.orders, named)
        frame = frame.orderBy(*order) if order and ordered else frame
        frame = self.page(frame, query) if paged else frame
        return frame, scope, self.columns(query, scope) + (extras(frame, scope) if extras else []), order

    def grouped(self, query: Query, frame: DataFrame, scope: Scope, carried: list[str], ordered: bool, paged: bool) -> tuple[DataFrame, Scope, None, list[Column]]:
        s = query.s
        by = {g: _hidden("g") for g in s.groups}
        outputs: list[tuple[str, str]] = []  # hidden name, name
        made: list[Column] = []
        for item in s.items or [Item(g) for g in s.groups]:
            same = next((h for g, h in by.items() if g == item.text or (nm.is_column(g) and nm.is_column(item.text) and nm.bare(g) == nm.bare(item.text))), None)
            name = item.alias or (nm.bare(item.text) if nm.is_column(item.text) else item.text)
            if same is None:
                same = _hidden("i")
                column = scope.expr(item.text)
                made.append(column.alias(same))
            outputs.append((same, name))
        for a in s.aggregates:
            h = _hidden("i")
            made.append(F.first(F.col(f"`{scope.made[id(a)]}`")).alias(h))
            outputs.append((h, a.alias))
        known = {g: h for g, h in by.items()} | {nm.bare(g): h for g, h in by.items() if nm.is_column(g)} | {n: h for h, n in outputs}
        later: dict[str, str] = {}

        def after(text: str) -> Column:
            if text in known:
                return F.col(f"`{known[text]}`")
            if text not in later:
                later[text] = _hidden("h")
                made.append(scope.expr(text).alias(later[text]))
            return F.col(f"`{later[text]}`")

        waiting = []
        for connector, node in s.having.pruned().items:
            if isinstance(node, pr.Raw):
                waiting.append((connector, after(node.text) if ex.has_aggregate(node.text) else F.expr(self._renamed(node.text, known))))
            else:
                column = after(node.key)
                waiting.append((connector, column.isNull() if node.op == "IS NULL" else column.isNotNull() if node.op == "IS NOT NULL" else compared(column, node.op, node.value)))
        sorts = []
        for o in s.orders:
            if o.kind == "random":
                sorts.append(F.rand(o.more))
                continue
            if o.kind == "relation":
                raise InvalidArgument("order_by_relation needs rows that are not grouped")
            column = after(o.text)
            if o.kind == "sequence":
                place = F.lit(len(o.more))
                for k in range(len(o.more) - 1, -1, -1):
                    place = F.when(column == o.more[k], F.lit(k)).otherwise(place)
                column = place
            sorts.append(column.desc() if o.descending else column.asc())
        keys = [scope.expr(g).alias(h) for g, h in by.items()] + [F.col(f"`{c}`") for c in carried]
        out = frame.groupBy(*keys).agg(*made) if made else frame.groupBy(*keys).agg(F.count(F.lit(1)).alias(_hidden("n")))
        if waiting:
            ways: list[list[Column]] = []
            for k, (connector, c) in enumerate(waiting):
                if k == 0 or connector == "OR":
                    ways.append([])
                ways[-1].append(c)
            out = out.where(reduce(lambda a, b: a | b, map(_all, ways)))
        out = out.orderBy(*sorts) if sorts and ordered else out
        if s.distinct:
            out = out.select(*dict.fromkeys(h for h, _ in outputs), *carried).distinct()
        out = self.page(out, query) if paged else out
        kept = [F.col(f"`{h}`").alias(n) for h, n in outputs] + [F.col(f"`{c}`") for c in carried]
        return out.select(*kept).alias(query.alias), scope, None, []

    @staticmethod
    def _renamed(text: str, known: dict[str, str]) -> str:
        return re.sub(r"'[^']*'|(?<![\w.`])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?", lambda m: f"`{known[m[0]]}`" if m[0] in known else m[0], text)

    def frame(self, query: Query, extras: Callable[[DataFrame, Scope], list[Column]] | None = None, restrict: Callable[[DataFrame, Scope], DataFrame] | None = None, paged: bool = True, ordered: bool = True) -> DataFrame:
        """The query's result. extras: hidden columns that are returned too."""
        relations = query.s.relations
        keys = [[_hidden("r") for _ in r.local] for r in relations]

        def more(frame: DataFrame, scope: Scope) -> list[Column]:
            own = [scope.local(l).alias(h) for r, names in zip(relations, keys, strict=True) for l, h in zip(r.local, names, strict=True)]
            return own + (extras(frame, scope) if extras else [])

        frame, scope, columns, _ = self.shaped(query, more, restrict=restrict, paged=paged, ordered=ordered)
        if columns is not None:
            frame = frame.select(*columns)
        elif relations and keys[0][0] not in frame.columns:  # grouped rows: keys are among the outputs
            frame = frame.select("*", *[F.col(f"`{nm.bare(l)}`").alias(h) for r, names in zip(relations, keys, strict=True) for l, h in zip(r.local, names, strict=True)], *(extras(frame, scope) if extras else []))
        elif extras and not relations and not query.s.distinct:
            frame = frame.select("*", *extras(frame, scope))
        frame = last_of_each(frame)
        if not relations:
            return frame
        limit = query.s.limit if query.s.limit is not None else query.s.page[0] if query.s.page else None
        few = paged and limit is not None
        if few:  # rows are chosen once, when first read; the relations' scans are filtered by the keys of these rows
            frame = self.session.held(frame)
        place = _hidden("place")
        sort = bool(query.s.orders) and ordered
        if sort:  # joins lose the order; ids are given after the sort and rise with it
            frame = frame.withColumn(place, F.monotonically_increasing_id())
        for r, names in zip(relations, keys, strict=True):
            frame = self.with_relation(frame, r, names, few, few and limit <= PAGE_ROWS)
        frame = frame.orderBy(place) if sort else frame
        return frame.drop(place, *[h for names in keys for h in names])

    def with_relation(self, parents: DataFrame, r: Relation, locals_: list[str], few: bool = False, send: bool = False) -> DataFrame:
        """Adds the related rows as a struct or, for many, an array of structs in the order asked for.
        few: the parents are a page; send: and so small by its limit that its keys may be broadcast."""
        sub = r.sub
        foreign = [_hidden("f") for _ in r.foreign]
        sorts = [_hidden("s") for _ in sub.s.orders]

        def extras(frame: DataFrame, scope: Scope) -> list[Column]:
            named = {i.alias: scope.expr(i.text) for i in sub.s.items if i.alias} | {a.alias: F.col(f"`{scope.made[id(a)]}`") for a in sub.s.aggregates if id(a) in scope.made}
            # the order's columns: a descending one is ranked, not negated, so the window below sorts by it again
            out = [scope.local(f).alias(h) for f, h in zip(r.foreign, foreign, strict=True)]
            for o, h in zip(sub.s.orders, sorts, strict=True):
                column = F.rand(o.more) if o.kind == "random" else named.get(o.text) if o.text in named else scope.expr(o.text)
                if o.kind == "sequence":
                    place = F.lit(len(o.more))
                    for k in range(len(o.more) - 1, -1, -1):
                        place = F.when(column == o.more[k], F.lit(k)).otherwise(place)
                    column = place
                out.append(column.alias(h))
            return out

        def current(frame: DataFrame, scope: Scope) -> DataFrame:
            names = [_hidden("p") for _ in locals_]
            present = parents.select(*[F.col(l).alias(n) for l, n in zip(locals_, names, strict=True)]).distinct()
            present = F.broadcast(present) if send else present
            return frame.join(present, _all([scope.local(f) == F.col(n) for f, n in zip(r.foreign, names, strict=True)]), "left_semi")

        child = self.frame(sub, extras, restrict=current if few or sub.s.limit is not None or sub.s.offset else None)
        visible = [c for c in child.columns if c not in (*foreign, *sorts)]
        struct = F.struct(*[F.col(f"`{c}`") for c in visible])
        ties = [F.col(f"`{f.name}`") for f in child.schema if f.name in visible and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        order = [F.col(h).desc() if o.descending else F.col(h).asc() for o, h in zip(sub.s.orders, sorts, strict=True)]
        rank, name = _hidden("n"), _hidden("x")
        plain = len(ties) == len(visible) and not any(o.descending for o in sub.s.orders)
        if plain and (not r.many or sub.s.limit_per_parent is None):
            # ascending rows need no window: the least of them, or all, sorted once where they are gathered
            whole = F.struct(*[F.col(f"`{h}`") for h in sorts], *[t.alias(f"t{k}") for k, t in enumerate(ties)], struct.alias("row"))
            held = child.groupBy(*foreign).agg((F.transform(F.sort_array(F.collect_list(whole)), lambda x: x["row"]) if r.many else F.min(whole)["row"]).alias(name))
            return self._nested(parents, r, locals_, foreign, held, name)
        ranked = child.withColumn(rank, F.row_number().over(Window.partitionBy(*foreign).orderBy(*order, *ties)))
        most = sub.s.limit_per_parent if r.many else 1
        ranked = ranked.where(F.col(rank) <= most) if most is not None else ranked
        if r.many:
            held = ranked.groupBy(*foreign).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank), struct.alias("row")))), lambda x: x["row"]).alias(name))
        else:
            held = ranked.select(*foreign, struct.alias(name))
        return self._nested(parents, r, locals_, foreign, held, name)

    @staticmethod
    def _nested(parents: DataFrame, r: Relation, locals_: list[str], foreign: list[str], held: DataFrame, name: str) -> DataFrame:
        on = []
        for l, f in zip(locals_, foreign, strict=True):
            on.append(F.col(l) == F.col(f))
            if isinstance(parents.schema[l].dataType, T.StringType):
                on.append(F.col(l) != "")
        joined = parents.join(held, _all(on), "left")
        value = F.col(name)
        if r.many:
            value = F.coalesce(value, F.array().cast(held.schema[name].dataType))
        kept = [F.col(f"`{c}`") for c in parents.columns if c != r.alias]
        return joined.select(*kept, value.alias(r.alias))

    def total(self, query: Query, whole: bool = False) -> DataFrame:
        """A frame with as many rows as the query has; ``whole``: without its limit and page."""
        out = query.copy()
        out.s.relations, out.s.page = [], None
        if whole:
            out.s.limit, out.s.offset = None, 0
        if out.s.limit is None and not out.s.offset:
            out.s.orders = []
        used = {id(n.aggregate) for n in out.s.where.walk() if isinstance(n, pr.OnAggregate)}
        out.s.aggregates = [a for a in out.s.aggregates if id(a) in used]
        return self.frame(out)


def last_of_each(frame: DataFrame) -> DataFrame:
    """Of columns of the same name, the last stays, as in rows read by name."""
    names = frame.columns
    if len(set(names)) == len(names):
        return frame
    last = {n: k for k, n in enumerate(names)}
    numbered = frame.toDF(*[f"{k}" for k in range(len(names))])
    return numbered.select(*[F.col(f"`{k}`").alias(n) for n, k in last.items()])
