"""The fluent builder. A query only records what is asked; compile() makes one lazy DataFrame of it."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from relquery.functions import expressions as ex
from relquery.functions import names as nm
from relquery.functions.names import InvalidArgument
from relquery.plans import predicates as pr

if TYPE_CHECKING:
    from relquery.operators.result import Result
    from relquery.session import Session

_MISSING = object()


@dataclass
class Source:
    source: Any  # a table's name, a Query or a DataFrame
    alias: str


@dataclass
class Join:
    source: Source
    on: str
    how: str


@dataclass
class Item:
    """A projected expression."""

    text: str
    alias: str | None = None


@dataclass
class Aggregate:
    """An extra column from related rows. kind: count, sum, avg, min, max or calculation."""

    kind: str
    sub: Query
    foreign: list[str]
    local: list[str]
    text: str | None
    alias: str
    joined: bool = False
    shared: Any = None  # aggregates with the same relation, keys and filter share one scan


@dataclass
class Relation:
    """Related rows, nested under ``alias``."""

    sub: Query
    foreign: list[str]
    local: list[str]
    alias: str
    many: bool


@dataclass
class Order:
    """kind: column, sequence, relation or random."""

    kind: str
    text: str = ""
    descending: bool = False
    more: Any = None


@dataclass
class State:
    sources: list[Source] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    joins: list[Join] = field(default_factory=list)
    where: pr.Group = field(default_factory=pr.Group)
    groups: list[str] = field(default_factory=list)
    having: pr.Group = field(default_factory=pr.Group)
    orders: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    aggregates: list[Aggregate] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    page: tuple[int, int] | None = None
    count_rows: bool = False
    limit_per_parent: int | None = None


#: Parts of a query that start_cache() records.
_RECORDED = ("sources", "items", "joins", "where", "groups", "having", "orders", "aggregates", "relations")


def _items(state: State, name: str) -> list:
    part = getattr(state, name)
    return part.items if isinstance(part, pr.Group) else part


def _joined(first: State, more: State) -> State:
    """A new state with the parts of both."""
    out = State(distinct=first.distinct or more.distinct)
    for name in _RECORDED:
        _items(out, name).extend([*_items(first, name), *_items(more, name)])
    return out


class Query:
    """Methods change the query and return it; ``copy()`` branches off."""

    def __init__(self, session: Session) -> None:
        self.session = session
        self.s = State()
        self._open: list[pr.Group] = []
        self._kept, self._begun = State(), None  # recorded clauses; where the recording began
        self._set: dict[str, Any] = {}
        self._insert_rows: list[dict[str, Any]] = []
        self._update_rows: list[dict[str, Any]] = []
        self._index = ""

    def copy(self) -> Query:
        out = Query(self.session)
        out.s = copy.copy(self.s)
        for name in ("sources", "items", "joins", "groups", "orders", "aggregates", "relations"):
            setattr(out.s, name, list(getattr(self.s, name)))
        out.s.where, out.s.having = copy.deepcopy(self.s.where), copy.deepcopy(self.s.having)
        out._kept = self._kept
        out._set, out._insert_rows, out._update_rows, out._index = dict(self._set), list(self._insert_rows), list(self._update_rows), self._index
        return out

    def reset_query(self) -> Query:
        """Empty again, but for recorded clauses."""
        self.s, self._open = _joined(State(), self._kept), []
        self._set, self._insert_rows, self._update_rows, self._index = {}, [], [], ""
        return self

    def start_cache(self) -> Query:
        """From now on clauses are recorded; reset_query() keeps them."""
        if self._begun is None:
            self._begun = {name: len(_items(self.s, name)) for name in _RECORDED} | {"distinct": self.s.distinct}
        return self

    def stop_cache(self) -> Query:
        if self._begun is not None:
            more = State(distinct=self.s.distinct and not self._begun["distinct"])
            for name in _RECORDED:
                _items(more, name).extend(_items(self.s, name)[self._begun[name] :])
            self._kept, self._begun = _joined(self._kept, more), None
        return self

    def flush_cache(self) -> Query:
        """Forgets what was recorded; clauses of the present query stay."""
        self._kept, self._begun = State(), None
        return self

    # ------------------------------------------------------------ queued writes

    def set(self, key: Any, value: Any = None, escape: bool = True) -> Query:
        """Values for the next insert(), replace() or update(). escape=False: the value is an expression."""
        from relquery.operators.writes import Raw

        for k, v in key.items() if isinstance(key, Mapping) else [(key, value)]:
            self._set[nm.column(k)] = v if escape or v is None else Raw(v)
        return self

    def set_insert_batch(self, rows: Any, value: Any = None, escape: bool = True) -> Query:
        """Rows for the next insert_batch(): a list of mappings, one mapping, or a column and its value."""
        self._insert_rows += self._queued(rows, value, escape)
        return self

    def set_update_batch(self, rows: Any, index: str = "", escape: bool = True) -> Query:
        """Rows for the next update_batch(), each with its index."""
        made = self._queued(rows, None, escape)
        if index and any(index not in r for r in made):
            raise InvalidArgument(f"each row needs {index!r}")
        self._update_rows += made
        self._index = index or self._index
        return self

    @staticmethod
    def _queued(rows: Any, value: Any, escape: bool) -> list[dict[str, Any]]:
        from relquery.operators.writes import Raw

        rows = [{rows: value}] if isinstance(rows, str) else [rows] if isinstance(rows, Mapping) else list(rows)
        return [{nm.column(k): v if escape or v is None else Raw(v) for k, v in r.items()} for r in rows]

    def _written(self, table: str) -> str:
        """The table to write to: named here or as the query's only source."""
        if table:
            return self.session.prefixed(table)
        if len(self.s.sources) != 1 or not isinstance(self.s.sources[0].source, str):
            raise InvalidArgument("a write names one table")
        return self.s.sources[0].source

    def _values(self, values: Mapping[str, Any] | None) -> dict[str, Any]:
        made = self._set | dict(values or {})
        if not made:
            raise InvalidArgument("nothing to set")
        return made

    def insert(self, table: str = "", values: Mapping[str, Any] | None = None) -> bool:
        done = self.session.insert(self._written(table), self._values(values))
        self.reset_query()
        return done

    def replace(self, table: str = "", values: Mapping[str, Any] | None = None, key: Any = None) -> bool:
        done = self.session.replace(self._written(table), self._values(values), key)
        self.reset_query()
        return done

    def update(self, table: str = "", values: Mapping[str, Any] | None = None) -> bool:
        """Sets what is queued in the rows that the query's conditions and limit leave."""
        done = self.session.update(self._written(table), self._values(values), self._conditions(), self.s.limit)
        self.reset_query()
        return done

    def delete(self, table: str = "") -> bool:
        if not self.s.where.pruned().items:
            raise InvalidArgument("delete needs a condition; empty_table takes all rows out")
        done = self.session.delete(self._written(table), self._conditions(), self.s.limit)
        self.reset_query()
        return done

    def insert_batch(self, table: str = "", rows: Any = None) -> int:
        done = self.session.insert_batch(self._written(table), self._insert_rows + self._queued(rows or [], None, True))
        self.reset_query()
        return done

    def update_batch(self, table: str = "", rows: Any = None, index: str = "") -> int:
        done = self.session.update_batch(self._written(table), self._update_rows + self._queued(rows or [], None, True), index or self._index, self._conditions())
        self.reset_query()
        return done

    def _conditions(self) -> Query | None:
        return self if self.s.where.pruned().items else None

    # ------------------------------------------------------------ sources

    def from_(self, *given: Any) -> Query:
        """Tables ("t", "t a", "t AS a"; several make a Cartesian product), queries or frames, or {source: alias}."""
        for g in given:
            for one in nm.split_list(g) if isinstance(g, str) else g if isinstance(g, (list, tuple)) else [g]:
                self.s.sources.append(self._source(one))
        return self

    table = from_

    def _source(self, given: Any) -> Source:
        if isinstance(given, str):
            name, alias = nm.table_and_alias(given, "table")
            return Source(self.session.prefixed(name), alias)
        source, alias, _ = nm.relation(given)
        return Source(source, alias)

    @property
    def alias(self) -> str:
        if not self.s.sources:
            raise InvalidArgument("no table is named")
        return self.s.sources[0].alias

    def join(self, given: Any, on: str, how: str = "") -> Query:
        """how: LEFT, RIGHT, OUTER, INNER, LEFT OUTER, RIGHT OUTER, FULL OUTER, FULL; any other joins inner.
        A condition without operator names columns that both sides have."""
        kinds = {"LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right", "OUTER": "full", "FULL": "full", "FULL OUTER": "full"}
        self.s.joins.append(Join(self._source(given), on, kinds.get(" ".join(how.upper().split()), "inner")))
        return self

    # ------------------------------------------------------------ projection

    def select(self, given: Any = "*", escape: bool | None = None) -> Query:
        """Appends to the projection. escape=False: the text is one raw expression."""
        parts = [given] if escape is False and isinstance(given, str) else nm.split_list(given) if isinstance(given, str) else [str(g).strip() for g in given]
        self.s.items += [self._item(p) for p in parts if p]
        return self

    add_select = select

    @staticmethod
    def _item(text: str) -> Item:
        depth, cut, upper = 0, None, text.upper()
        for k, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if depth == 0 and upper.startswith(" AS ", k):
                cut = k
        if cut is not None:
            return Item(text[:cut].strip(), text[cut + 4 :].strip().strip("`\""))
        words = text.split()
        if len(words) == 2 and nm.is_column(words[0]) and nm.is_table(words[1]):
            return Item(words[0], words[1])
        return Item(text)

    def _select_aggregate(self, kind: str, name: str, alias: str) -> Query:
        nm.column(name)
        self.s.items.append(Item(f"{kind}({name})", alias or nm.bare(name)))
        return self

    def select_max(self, name: str, alias: str = "") -> Query:
        return self._select_aggregate("max", name, alias)

    def select_min(self, name: str, alias: str = "") -> Query:
        return self._select_aggregate("min", name, alias)

    def select_avg(self, name: str, alias: str = "") -> Query:
        return self._select_aggregate("avg", name, alias)

    def select_sum(self, name: str, alias: str = "") -> Query:
        return self._select_aggregate("sum", name, alias)

    def distinct(self, on: bool = True) -> Query:
        self.s.distinct = on
        return self

    # ------------------------------------------------------------ predicates

    def _add(self, connector: str, node: Any) -> Query:
        (self._open[-1] if self._open else self.s.where).add(connector, node)
        return self

    def _where(self, connector: str, key: Any, value: Any) -> Query:
        if isinstance(key, Mapping):
            for k, v in key.items():
                self._add(connector, pr.condition(k, v, True))
            return self
        return self._add(connector, pr.condition(key, None if value is _MISSING else value, value is not _MISSING))

    def where(self, key: Any, value: Any = _MISSING, escape: bool | None = None) -> Query:
        return self._where("AND", key, value)

    def or_where(self, key: Any, value: Any = _MISSING, escape: bool | None = None) -> Query:
        return self._where("OR", key, value)

    def _in(self, connector: str, key: str, values: Any, negated: bool) -> Query:
        values = list(values) if isinstance(values, (list, tuple, set, frozenset, range)) else [values]
        return self._add(connector, pr.In(nm.column(key), values, negated))

    def where_in(self, key: str, values: Any) -> Query:
        return self._in("AND", key, values, False)

    def or_where_in(self, key: str, values: Any) -> Query:
        return self._in("OR", key, values, False)

    def where_not_in(self, key: str, values: Any) -> Query:
        return self._in("AND", key, values, True)

    def or_where_not_in(self, key: str, values: Any) -> Query:
        return self._in("OR", key, values, True)

    def where_not(self, key: str, value: Any) -> Query:
        return self._add("AND", pr.Compare(nm.column(key), "!=", value))

    def or_where_not(self, key: str, value: Any) -> Query:
        return self._add("OR", pr.Compare(nm.column(key), "!=", value))

    def where_null(self, key: str) -> Query:
        return self._add("AND", pr.Compare(nm.column(key), "IS NULL", None))

    def or_where_null(self, key: str) -> Query:
        return self._add("OR", pr.Compare(nm.column(key), "IS NULL", None))

    def where_not_null(self, key: str) -> Query:
        return self._add("AND", pr.Compare(nm.column(key), "IS NOT NULL", None))

    def or_where_not_null(self, key: str) -> Query:
        return self._add("OR", pr.Compare(nm.column(key), "IS NOT NULL", None))

    def _between(self, connector: str, key: str, values: Any, negated: bool) -> Query:
        if not isinstance(values, (list, tuple)) or len(values) != 2:
            raise InvalidArgument("between needs two values")
        return self._add(connector, pr.Between(nm.column(key), *values, negated))

    def where_between(self, key: str, values: Any) -> Query:
        return self._between("AND", key, values, False)

    def or_where_between(self, key: str, values: Any) -> Query:
        return self._between("OR", key, values, False)

    def where_not_between(self, key: str, values: Any) -> Query:
        return self._between("AND", key, values, True)

    def or_where_not_between(self, key: str, values: Any) -> Query:
        return self._between("OR", key, values, True)

    def _like(self, connector: str, key: Any, term: Any, side: str, negated: bool) -> Query:
        for k, t in key.items() if isinstance(key, Mapping) else [(key, term)]:
            self._add(connector, pr.Like(nm.column(k), str(t), side.lower(), negated))
        return self

    def like(self, key: Any, term: Any = "", side: str = "both") -> Query:
        return self._like("AND", key, term, side, False)

    def or_like(self, key: Any, term: Any = "", side: str = "both") -> Query:
        return self._like("OR", key, term, side, False)

    def not_like(self, key: Any, term: Any = "", side: str = "both") -> Query:
        return self._like("AND", key, term, side, True)

    def or_not_like(self, key: Any, term: Any = "", side: str = "both") -> Query:
        return self._like("OR", key, term, side, True)

    def search(self, term: Any, columns: Any = (), any_of: bool = True) -> Query:
        """One group: the term in any (or in each) of the columns."""
        columns = [c for c in ([columns] if isinstance(columns, str) else columns) if c and c.strip()]
        if columns:
            self.group_start()
            for c in columns:
                self._like("OR" if any_of else "AND", c, term, "both", False)
            self.group_end()
        return self

    # ------------------------------------------------------------ groups

    def group_start(self, negated: bool = False, connector: str = "AND") -> Query:
        node = pr.Group(negated=negated)
        self._add(connector, node)
        self._open.append(node)
        return self

    def or_group_start(self) -> Query:
        return self.group_start(connector="OR")

    def not_group_start(self) -> Query:
        return self.group_start(negated=True)

    def or_not_group_start(self) -> Query:
        return self.group_start(negated=True, connector="OR")

    def group_end(self) -> Query:
        if not self._open:
            raise InvalidArgument("no group is open")
        self._open.pop()
        return self

    def group(self, callback: Callable[[Query], Any], connector: str = "AND") -> Query:
        if not callable(callback):
            raise InvalidArgument("a group needs a callback")
        depth = len(self._open)
        self.group_start(connector=connector)
        try:
            callback(self)
        finally:
            del self._open[depth:]
        return self

    def or_group(self, callback: Callable[[Query], Any]) -> Query:
        return self.group(callback, "OR")

    def when(self, asked: Any, callback: Callable[..., Any], default: Callable[..., Any] | None = None) -> Query:
        asked = asked(self) if callable(asked) else asked
        chosen = callback if asked else default
        if chosen is not None:
            if not callable(chosen):
                raise InvalidArgument("when needs a callback")
            chosen(self)
        return self

    def unless(self, asked: Any, callback: Callable[..., Any], default: Callable[..., Any] | None = None) -> Query:
        return self.when(not (asked(self) if callable(asked) else asked), callback, default)

    # ------------------------------------------------------------ related rows

    def _nested(self, source: Any, alias: str, callback: Any) -> Query:
        if callback is not None and not callable(callback):
            raise InvalidArgument("the callback can't be called")
        sub = Query(self.session)
        sub.s.sources.append(Source(self.session.prefixed(source) if isinstance(source, str) else source, alias))
        if callback is not None:
            callback(sub)
            sub._open.clear()
        return sub

    def _exists(self, connector: str, negated: bool, callback: Any) -> Query:
        if not callable(callback):
            raise InvalidArgument("where_exists needs a callback")
        sub = Query(self.session)
        callback(sub)
        sub._open.clear()
        return self._add(connector, pr.Exists(sub, [], [], negated))

    def where_exists(self, callback: Any) -> Query:
        return self._exists("AND", False, callback)

    def where_not_exists(self, callback: Any) -> Query:
        return self._exists("AND", True, callback)

    def or_where_exists(self, callback: Any) -> Query:
        return self._exists("OR", False, callback)

    def or_where_not_exists(self, callback: Any) -> Query:
        return self._exists("OR", True, callback)

    def _exists_relation(self, connector: str, negated: bool, given: Any, foreign: Any, local: Any, callback: Any) -> Query:
        source, alias, _ = nm.relation(given)
        f, l = nm.key_pairs(foreign, local)
        return self._add(connector, pr.Exists(self._nested(source, alias, callback), f, l, negated))

    def where_exists_relation(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._exists_relation("AND", False, relation, foreign, local, callback)

    def where_not_exists_relation(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._exists_relation("AND", True, relation, foreign, local, callback)

    def or_where_exists_relation(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._exists_relation("OR", False, relation, foreign, local, callback)

    def or_where_not_exists_relation(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._exists_relation("OR", True, relation, foreign, local, callback)

    where_doesnt_have = where_not_exists_relation
    or_where_doesnt_have = or_where_not_exists_relation

    def _has(self, connector: str, given: Any, foreign: Any, local: Any, callback: Any, op: Any, count: Any) -> Query:
        if isinstance(callback, str):
            callback, op, count = None, callback, op if op is not None else count
        op, count = op or ">=", 1 if count is None else count
        if op not in pr.OPERATORS:
            raise InvalidArgument(f"invalid operator: {op!r}")
        if not isinstance(count, int) or isinstance(count, bool) or count < 0:
            raise InvalidArgument("the count is a number, 0 or more")
        if op == ">=" and count == 1:
            return self._exists_relation(connector, False, given, foreign, local, callback)
        source, alias, _ = nm.relation(given)
        f, l = nm.key_pairs(foreign, local)
        return self._add(connector, pr.Has(self._nested(source, alias, callback), f, l, op, count))

    def where_has(self, relation: Any, foreign: Any, local: Any, callback: Any = None, op: Any = None, n: Any = None) -> Query:
        return self._has("AND", relation, foreign, local, callback, op, n)

    def or_where_has(self, relation: Any, foreign: Any, local: Any, callback: Any = None, op: Any = None, n: Any = None) -> Query:
        return self._has("OR", relation, foreign, local, callback, op, n)

    # ------------------------------------------------------------ aggregates of related rows

    def _aggregate(self, kind: str, given: Any, foreign: Any, local: Any, text: Any = None, custom: Any = False, callback: Any = None, joined: bool = False) -> Query:
        if callable(custom):
            custom, callback = True, custom
        f, l = nm.key_pairs(foreign, local)
        source, alias, result = nm.relation(given)
        label = nm.table_and_alias(given if isinstance(given, str) else next(iter(given)))[0] if isinstance(given, str) or (isinstance(given, Mapping) and isinstance(next(iter(given)), str)) else alias
        if kind == "calculation":
            text = ex.calculation(text)
        elif kind != "count":
            if not custom and not nm.is_column(text):
                raise InvalidArgument(f"{kind} needs a column: {text!r}")
            text = ex.custom(text) if custom else text
        made = Aggregate(kind, self._nested(source, alias, callback), f, l, text, result or f"{label}_{kind}", joined)
        if isinstance(source, str):
            made.shared = (source, alias, tuple(f), tuple(l), id(callback) if callback else None)
            made.sub.kept_callback = callback  # keeps the id from being used again
        self.s.aggregates.append(made)
        return self

    def with_count(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._aggregate("count", relation, foreign, local, callback=callback)

    def with_sum(self, relation: Any, foreign: Any, local: Any, column: str, custom: Any = False, callback: Any = None) -> Query:
        return self._aggregate("sum", relation, foreign, local, column, custom, callback)

    def with_avg(self, relation: Any, foreign: Any, local: Any, column: str, custom: Any = False, callback: Any = None) -> Query:
        return self._aggregate("avg", relation, foreign, local, column, custom, callback)

    def with_max(self, relation: Any, foreign: Any, local: Any, column: str, custom: Any = False, callback: Any = None) -> Query:
        return self._aggregate("max", relation, foreign, local, column, custom, callback)

    def with_min(self, relation: Any, foreign: Any, local: Any, column: str, custom: Any = False, callback: Any = None) -> Query:
        return self._aggregate("min", relation, foreign, local, column, custom, callback)

    def with_calculation(self, relation: Any, foreign: Any, local: Any, expression: str, callback: Any = None) -> Query:
        return self._aggregate("calculation", relation, foreign, local, expression, callback=callback)

    def join_count(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self._aggregate("count", relation, foreign, local, callback=callback, joined=True)

    def join_sum(self, relation: Any, foreign: Any, local: Any, column: Any, callback: Any = None) -> Query:
        return self._aggregate("sum", relation, foreign, local, column, callback=callback, joined=True)

    def join_avg(self, relation: Any, foreign: Any, local: Any, column: Any, callback: Any = None) -> Query:
        return self._aggregate("avg", relation, foreign, local, column, callback=callback, joined=True)

    def join_min(self, relation: Any, foreign: Any, local: Any, column: Any, callback: Any = None) -> Query:
        return self._aggregate("min", relation, foreign, local, column, callback=callback, joined=True)

    def join_max(self, relation: Any, foreign: Any, local: Any, column: Any, callback: Any = None) -> Query:
        return self._aggregate("max", relation, foreign, local, column, callback=callback, joined=True)

    def join_calculation(self, relation: Any, foreign: Any, local: Any, expression: Any, callback: Any = None) -> Query:
        return self._aggregate("calculation", relation, foreign, local, expression, callback=callback, joined=True)

    def _where_aggregate(self, connector: str, text: str, value: Any) -> Query:
        name, _, op = text.strip().partition(" ")
        op = " ".join(op.upper().split()) or "="
        found = next((a for a in self.s.aggregates if a.alias == name), None)
        if found is None:
            raise InvalidArgument(f"no aggregate is called {name!r}")
        if op not in (*pr.OPERATORS, "BETWEEN", "NOT BETWEEN"):
            raise InvalidArgument(f"invalid operator: {op!r}")
        if "BETWEEN" in op and (not isinstance(value, (list, tuple)) or len(value) != 2):
            raise InvalidArgument("between needs two values")
        return self._add(connector, pr.OnAggregate(found, op, value))

    def where_aggregate(self, condition: str, value: Any) -> Query:
        return self._where_aggregate("AND", condition, value)

    def or_where_aggregate(self, condition: str, value: Any) -> Query:
        return self._where_aggregate("OR", condition, value)

    # ------------------------------------------------------------ eager loading

    def with_(self, relation: Any, foreign: Any, local: Any, multiple: Any = True, callback: Any = None) -> Query:
        if not isinstance(multiple, bool):
            raise InvalidArgument("multiple is True or False")
        source, alias, result = nm.relation(relation)
        f, l = nm.key_pairs(foreign, local)
        self.s.relations.append(Relation(self._nested(source, alias, callback), f, l, result or alias, multiple))
        return self

    def with_one(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self.with_(relation, foreign, local, False, callback)

    def with_many(self, relation: Any, foreign: Any, local: Any, callback: Any = None) -> Query:
        return self.with_(relation, foreign, local, True, callback)

    def limit_per_parent(self, n: int) -> Query:
        """In a relation's callback: at most n rows for each parent."""
        self.s.limit_per_parent = n
        return self

    # ------------------------------------------------------------ grouping, order, pages

    def group_by(self, given: Any) -> Query:
        self.s.groups += nm.split_list(given) if isinstance(given, str) else list(given)
        return self

    def having(self, key: Any, value: Any = _MISSING) -> Query:
        return self._having("AND", key, value)

    def or_having(self, key: Any, value: Any = _MISSING) -> Query:
        return self._having("OR", key, value)

    def _having(self, connector: str, key: Any, value: Any) -> Query:
        for k, v in key.items() if isinstance(key, Mapping) else [(key, value)]:
            self.s.having.add(connector, pr.condition(k, None if v is _MISSING else v, v is not _MISSING))
        return self

    def order_by(self, given: Any, direction: str = "") -> Query:
        direction = direction.upper().strip()
        if direction == "RANDOM":
            self.s.orders.append(Order("random", more=int(given) if str(given).lstrip("-").isdigit() else None))
            return self
        for part in nm.split_list(given) if isinstance(given, str) else given:
            head, _, last = part.rpartition(" ")
            own = last.upper() if last.upper() in ("ASC", "DESC") and head else ""
            self.s.orders.append(Order("column", head.strip() if own else part, (own or direction) == "DESC"))
        return self

    def latest(self, column: str = "created_at") -> Query:
        return self.order_by(nm.column(column), "DESC")

    def oldest(self, column: str = "created_at") -> Query:
        return self.order_by(nm.column(column), "ASC")

    def order_by_sequence(self, column: str, values: Any) -> Query:
        if not isinstance(values, (list, tuple)) or not values:
            raise InvalidArgument("a sequence of values is needed")
        self.s.orders.append(Order("sequence", nm.column(column), more=list(values)))
        return self

    def order_by_relation(self, table: Any, foreign: Any, local: Any, column: str, direction: str = "ASC") -> Query:
        if direction.upper() not in ("ASC", "DESC"):
            raise InvalidArgument(f"invalid direction: {direction!r}")
        source, alias, _ = nm.relation(table)
        f, l = nm.key_pairs(foreign, local)
        self.s.orders.append(Order("relation", nm.column(column), direction.upper() == "DESC", (self._nested(source, alias, None), f, l)))
        return self

    def limit(self, n: int | None, offset: int = 0) -> Query:
        self.s.limit = None if n is None else int(n)
        self.s.offset = int(offset) or self.s.offset
        return self

    def offset(self, n: int) -> Query:
        self.s.offset = int(n)
        return self

    def paginate(self, per_page: int = 15, page: int = 1) -> Query:
        if per_page < 1 or page < 1:
            raise InvalidArgument("page and page size are 1 or more")
        self.s.page, self.s.count_rows = (int(per_page), int(page)), True
        return self

    def calc_rows(self) -> Query:
        self.s.count_rows = True
        return self

    # ------------------------------------------------------------ results

    def _at(self, table: Any, limit: int | None = None, offset: int | None = None) -> Query:
        out = self.copy()
        if table:
            out.from_(table)
        if limit is not None:
            out.limit(limit, offset or 0)
        return out

    def to_df(self) -> DataFrame:
        """The query as one lazy DataFrame."""
        from relquery.plans.compiler import Compiler

        return Compiler(self.session).frame(self)

    def get(self, table: Any = "", limit: int | None = None, offset: int | None = None) -> Result:
        from relquery.operators.result import run

        return run(self._at(table, limit, offset))

    def get_where(self, table: Any = "", where: Any = None, limit: int | None = None, offset: int | None = None) -> Result:
        out = self._at(table, limit, offset)
        return (out.where(where) if where else out).get()

    def count_all_results(self, table: Any = "") -> int:
        from relquery.plans.compiler import Compiler

        out = self._at(table)
        self.session.log(out)
        return Compiler(self.session).total(out).count()

    def first(self, table: Any = "") -> Any:
        return self._at(table).limit(1).get().row()

    def value(self, column: str, table: Any = "") -> Any:
        return self._at(table).limit(1).get().value(column)

    def exists(self, table: Any = "") -> bool:
        out = self._at(table)
        self.session.log(out)
        return not out.to_df().isEmpty()

    def doesnt_exist(self, table: Any = "") -> bool:
        return not self.exists(table)

    def pluck(self, column: str, table: Any = "") -> list:
        return self._at(table).get().pluck(column)

    def chunk(self, size: int, callback: Callable[[list], Any], table: Any = "") -> int:
        from relquery.streaming.pages import chunk

        return chunk(self._at(table), size, callback)

    def chunk_by_id(self, size: int, callback: Callable[[list], Any], column: str = "id", table: Any = "") -> int:
        from relquery.streaming.pages import chunk_by_id

        return chunk_by_id(self._at(table), size, callback, column)

    def get_compiled_select(self, table: Any = "") -> str:
        from relquery.plans.text import select_text

        return select_text(self._at(table))

    # Related parts are resolved when the query is compiled, so there is nothing left to flush.
    def _settled(self, *_: Any) -> Query:
        return self

    process_aggregates = process_where_aggregates = process_join_aggregates = process_where_has = process_where_exists = _settled


# A copy of a query has predicates of its own, but shares what lies below them.
def _itself(self: Any, memo: Any) -> Any:
    return self


Query.__deepcopy__ = Aggregate.__deepcopy__ = _itself
