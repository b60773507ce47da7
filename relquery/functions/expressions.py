"""Arithmetic over columns and aggregates: what is allowed, and its form in Spark SQL."""

from __future__ import annotations

import re

from relquery.functions.names import InvalidArgument, is_column

# The functions and words that an expression may hold.
FUNCTIONS = (
    "SUM AVG COUNT MAX MIN ROUND FLOOR CEIL ABS COALESCE IFNULL NULLIF CASE WHEN THEN ELSE END DATEDIFF TIMESTAMPDIFF DAY MONTH YEAR NOW DATE CONCAT "
    "SUBSTRING TRIM UPPER LOWER LENGTH REPLACE CAST CONVERT IF AND OR IS NOT NULL AS"
).split()
MORE_FUNCTIONS = "POW SQRT MOD CURDATE CURTIME".split()
MORE_WORDS = "TRUE FALSE DISTINCT HOUR MINUTE SECOND CURDATE CURTIME POW SQRT MOD".split()
REFUSED = "INSERT UPDATE DELETE DROP UNION EXEC EXECUTE CREATE ALTER TRUNCATE".split()
REFUSED_IN_CUSTOM = "SELECT FROM JOIN".split()
REFUSED_IN_CALCULATION = "INTO VALUES SELECT FROM JOIN WHERE HAVING OUTFILE DUMPFILE".split()
REFUSED_MARKS = (";", "--", "/*", "*/", "||", "&&")
CUSTOM_MARKS, CALCULATION_MARKS = '()+-*/.,`"<>=', "()+-*/.,`%<>='\""
MAX_LENGTH = 2000

_CUSTOM, _CALCULATION = (re.compile(rf"[\w\s{re.escape(marks)}]+") for marks in (CUSTOM_MARKS, CALCULATION_MARKS))
_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_AGGREGATE = re.compile(r"\b(?:SUM|AVG|COUNT|MAX|MIN)\s*\(", re.I)


def _has_word(text: str, words: list[str]) -> bool:
    return re.search(rf"\b(?:{'|'.join(words)})\b", text, re.I) is not None


def _balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def _allowed(text: object, chars: re.Pattern, refused: list[str], functions: list[str], words: list[str], strings: bool) -> bool:
    if not isinstance(text, str) or not text or len(text) > MAX_LENGTH or not chars.fullmatch(text) or not _balanced(text):
        return False
    if any(m in text for m in REFUSED_MARKS) or re.search(r"\b(?:xp_|sp_)", text) or _has_word(text, [*REFUSED, *refused]):
        return False
    outside_case = re.sub(r"\bCASE\b.*?\bEND\b", "", text, flags=re.I | re.S)
    if _has_word(outside_case, ["OR", "AND", "IS", "NOT"]):
        return False
    if strings:
        text = _STRING.sub(" _literal ", text)
    if any(name.upper() not in functions for name in re.findall(r"[\"`]?([A-Za-z_]\w*)[\"`]?\s*\(", text)):
        return False
    tokens = (t.replace("`", "").replace('"', "") for t in re.split(r"[\s()+\-*/,%<>=]+", text) if t)
    return all(re.fullmatch(r"\d+\.?\d*(?:[eE]\d+)?|\.\d+", t) or t.upper() in words or is_column(t) for t in tokens)


def is_custom(text: object) -> bool:
    """May stand as the argument of one aggregate."""
    return _allowed(text, _CUSTOM, REFUSED_IN_CUSTOM, FUNCTIONS, FUNCTIONS, False)


def is_calculation(text: object) -> bool:
    """May combine several aggregates."""
    return _allowed(text, _CALCULATION, REFUSED_IN_CALCULATION, [*FUNCTIONS, *MORE_FUNCTIONS], [*FUNCTIONS, *MORE_WORDS], True)


def custom(text: object) -> str:
    if not is_custom(text):
        raise InvalidArgument(f"invalid expression: {str(text)[:80]!r}")
    return to_spark(text.replace('"', "`"))  # double quotes stand around names here, around strings below


def calculation(text: object) -> str:
    if not is_calculation(text):
        raise InvalidArgument(f"invalid calculation: {str(text)[:80]!r}")
    return to_spark(text)


def has_aggregate(text: str) -> bool:
    return _AGGREGATE.search(text) is not None


_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?|<=|>=|<>|!=|\S|\s+")
# Names of types in casts that Spark calls otherwise.
TYPES = {"CHAR": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "SIGNED": "BIGINT", "UNSIGNED": "BIGINT", "INTEGER": "INT", "DATETIME": "TIMESTAMP", "REAL": "DOUBLE"}


def to_spark(text: str) -> str:
    """The expression in Spark SQL: division by zero gives null, and names that Spark lacks are replaced."""
    tokens = _TOKEN.findall(text)
    out, _ = _rewrite(tokens, 0, len(tokens))
    return out


def _closing(tokens: list[str], at: int) -> int:
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if depth == 0:
            return k
    raise InvalidArgument("unbalanced brackets")


def _operand(tokens: list[str], at: int, end: int) -> tuple[str, int]:
    """The operand that starts at a token, and where it ends."""
    while at < end and tokens[at].isspace():
        at += 1
    if at >= end:
        raise InvalidArgument("an operand is missing")
    t = tokens[at]
    if t in "+-":
        inner, stop = _operand(tokens, at + 1, end)
        return t + inner, stop
    if t == "(":
        close = _closing(tokens, at)
        return "(" + _rewrite(tokens, at + 1, close)[0] + ")", close + 1
    if t.upper() == "CASE":
        depth, k = 0, at
        while k < end:
            depth += (tokens[k].upper() == "CASE") - (tokens[k].upper() == "END")
            k += 1
            if depth == 0:
                break
        return "(CASE" + _rewrite(tokens, at + 1, k)[0] + ")", k
    following = at + 1
    while following < end and tokens[following].isspace():
        following += 1
    if re.match(r"[A-Za-z_]", t) and following < end and tokens[following] == "(":
        return _call(tokens, at, following)
    return _plain(t), at + 1


def _plain(token: str) -> str:
    if token[0] == '"':
        return "'" + token[1:-1].replace("'", "\\'") + "'"
    return {"CURDATE": "current_date()", "CURTIME": "date_format(now(), 'HH:mm:ss')"}.get(token.upper(), token)


def _call(tokens: list[str], at: int, opening: int) -> tuple[str, int]:
    close = _closing(tokens, opening)
    name, inner = tokens[at].upper(), tokens[opening + 1 : close]
    if name == "CURTIME":
        return "date_format(now(), 'HH:mm:ss')", close + 1
    if name in ("CAST", "CONVERT"):
        mark = ("AS",) if name == "CAST" else (",",)
        cut = max((k for k, t in enumerate(inner) if t.upper() in mark), default=None)
        if cut is None:
            raise InvalidArgument(f"{name} needs a type")
        kind = "".join(inner[cut + 1 :]).strip()
        return f"CAST({_rewrite(inner, 0, cut)[0].strip()} AS {TYPES.get(kind.upper(), kind)})", close + 1
    if name == "MOD":
        return f"try_mod({_rewrite(inner, 0, len(inner))[0]})", close + 1
    return f"{tokens[at]}({_rewrite(inner, 0, len(inner))[0]})", close + 1


def _rewrite(tokens: list[str], at: int, end: int) -> tuple[str, int]:
    out = []
    while at < end:
        t = tokens[at]
        if t in "/%" and not t.isspace():
            operand, at = _operand(tokens, at + 1, end)
            out.append(f"{t} nullif({operand}, 0)")
        elif t.isspace() or t in ("*", ",", "=", "<", ">", "<=", ">=", "<>", "!=", ".") or t in "+-":
            out.append(t)
            at += 1
        elif t.upper() in ("WHEN", "THEN", "ELSE", "END", "AND", "OR", "IS", "NOT", "NULL", "AS", "DISTINCT"):
            out.append(t)
            at += 1
        else:
            operand, at = _operand(tokens, at, end)
            out.append(operand)
    return "".join(out), at
