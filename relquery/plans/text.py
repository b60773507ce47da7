"""SQL text of a query, for logs and for reading; Spark runs the tree, not the text."""

from __future__ import annotations

from typing import Any

from relquery.plans import predicates as pr
from relquery.query import Aggregate, Query


def _source(query: Query, given: Any, alias: str) -> str:
    name = given if isinstance(given, str) else f"({select_text(given)})" if isinstance(given, Query) else "(frame)"
    return name if name == alias else f"{name} {alias}"


def _keys(sub: Query, main: str, foreign: list[str], local: list[str]) -> list[str]:
    full = lambda a, c: c if "." in c else f"{a}.{c}"
    return [f"{full(sub.alias, f)} = {full(main, l)}" for f, l in zip(foreign, local, strict=True)]


def _inner(query: Query, sub: Query, what: str, foreign: list[str], local: list[str]) -> str:
    own = sub.s.where.pruned()
    parts = _keys(sub, query.alias, foreign, local) + ([f"({group_text(sub, own)})" if len(own.alternatives()) > 1 else group_text(sub, own)] if own.items else [])
    rest = select_text(sub, what, parts)
    return f"({rest})"


def aggregate_text(query: Query, a: Aggregate) -> str:
    what = "COUNT(*)" if a.kind == "count" else a.text if a.kind == "calculation" else f"{a.kind.upper()}({a.text})"
    return _inner(query, a.sub, what, a.foreign, a.local)


def node_text(query: Query, node: Any) -> str:
    quote = query.session.escape
    if isinstance(node, pr.Group):
        return f"{'NOT ' if node.negated else ''}({group_text(query, node)})"
    if isinstance(node, pr.Raw):
        return node.text
    if isinstance(node, pr.Compare):
        return f"{node.key} {node.op}" if node.op.startswith("IS") else f"{node.key} {node.op} {quote(node.value)}"
    if isinstance(node, pr.In):
        return f"{node.key} {'NOT ' if node.negated else ''}IN ({', '.join(map(quote, node.values))})"
    if isinstance(node, pr.Between):
        return f"{node.key} {'NOT ' if node.negated else ''}BETWEEN {quote(node.low)} AND {quote(node.high)}"
    if isinstance(node, pr.Like):
        term = query.session.escape_like_str(node.term)
        term = {"none": term, "before": f"%{term}", "after": f"{term}%"}.get(node.side, f"%{term}%")
        return f"{node.key} {'NOT ' if node.negated else ''}LIKE {quote(term)} ESCAPE '!'"
    if isinstance(node, pr.Exists):
        return f"{'NOT ' if node.negated else ''}EXISTS {_inner(query, node.sub, '1', node.foreign, node.local)}"
    if isinstance(node, pr.Has):
        return f"{_inner(query, node.sub, 'COUNT(*)', node.foreign, node.local)} {node.op} {node.count}"
    value = f"{quote(node.value[0])} AND {quote(node.value[1])}" if "BETWEEN" in node.op else quote(node.value)
    return f"COALESCE({aggregate_text(query, node.aggregate)}, 0) {node.op} {value}"


def group_text(query: Query, group: pr.Group) -> str:
    return " ".join(f"{'' if k == 0 else connector + ' '}{node_text(query, node)}" for k, (connector, node) in enumerate(group.items))


def select_text(query: Query, what: str | None = None, first: list[str] | None = None) -> str:
    s = query.s
    if not s.sources:
        return "SELECT " + ", ".join(i.text for i in s.items)
    items = [i.text if not i.alias else f"{i.text} AS {i.alias}" for i in s.items] or ["*"]
    items += [f"{aggregate_text(query, a)} AS {a.alias}" for a in s.aggregates if not a.joined] + [f"{a.alias}.value AS {a.alias}" for a in s.aggregates if a.joined]
    out = f"SELECT {'DISTINCT ' if s.distinct else ''}{what or ', '.join(items)} FROM " + ", ".join(_source(query, x.source, x.alias) for x in s.sources)
    for j in s.joins:
        out += f" {j.how.upper()} JOIN {_source(query, j.source.source, j.source.alias)} " + (f"ON {j.on}" if any(c in j.on for c in "=<>") else f"USING ({j.on})")
    for a in s.aggregates:
        if a.joined:
            call = "COUNT(*)" if a.kind == "count" else a.text if a.kind == "calculation" else f"{a.kind.upper()}({a.text})"
            own = a.sub.s.where.pruned()
            inner = f"SELECT {', '.join(a.foreign)}, {call} AS value FROM {_source(a.sub, a.sub.s.sources[0].source, a.sub.alias)}" + (f" WHERE {group_text(a.sub, own)}" if own.items else "") + f" GROUP BY {', '.join(a.foreign)}"
            out += f" LEFT JOIN ({inner}) {a.alias} ON " + " AND ".join(f"{a.alias}.{f} = {query.alias}.{l.rpartition('.')[2]}" for f, l in zip(a.foreign, a.local, strict=True))
    where = s.where.pruned()
    parts = first if first is not None else [group_text(query, where)] if where.items else []
    out += f" WHERE {' AND '.join(parts)}" if parts else ""
    out += f" GROUP BY {', '.join(s.groups)}" if s.groups else ""
    having = s.having.pruned()
    out += f" HAVING {group_text(query, having)}" if having.items else ""
    orders = []
    for o in s.orders:
        if o.kind == "random":
            text = "RAND()" if o.more is None else f"RAND({o.more})"
        elif o.kind == "sequence":
            text = "CASE " + " ".join(f"WHEN {o.text} = {query.session.escape(v)} THEN {k}" for k, v in enumerate(o.more)) + f" ELSE {len(o.more)} END"
        elif o.kind == "relation":
            sub, foreign, local = o.more
            text = _inner(query, sub, f"{'MAX' if o.descending else 'MIN'}({o.text})", foreign, local)
        else:
            text = o.text
        orders.append(text + (" DESC" if o.descending else " ASC" if o.kind in ("column", "relation") else ""))
    out += f" ORDER BY {', '.join(orders)}" if orders else ""
    limit, offset = s.limit, s.offset
    if s.page and limit is None:
        limit, offset = s.page[0], s.page[0] * (s.page[1] - 1)
    out += f" LIMIT {limit}" if limit is not None else ""
    return out + (f" OFFSET {offset}" if offset else "")
