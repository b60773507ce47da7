"""Identifiers: what a table, column, relation or key may be called."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping


class InvalidArgument(ValueError):
    """An argument that no query may be built from."""


# Words and marks that no identifier may hold.
RESERVED = "SELECT INSERT UPDATE DELETE DROP UNION OR AND WHERE HAVING FROM JOIN INTO VALUES SET ALTER CREATE TRUNCATE EXEC EXECUTE".split()
MAX_NAME = 64

_WORD = r"[A-Za-z_][A-Za-z0-9_]*"
_RESERVED = re.compile(rf"\b(?:{'|'.join(RESERVED)})\b", re.I)
_PROCEDURE = re.compile(r"\b(?:xp_|sp_)")


def is_column(name: object) -> bool:
    """``column`` or ``table.column``."""
    return isinstance(name, str) and len(name) <= MAX_NAME and re.fullmatch(rf"{_WORD}(?:\.{_WORD})?", name) is not None and not _RESERVED.search(name) and not _PROCEDURE.search(name)


def is_table(name: object) -> bool:
    return isinstance(name, str) and len(name) <= MAX_NAME and re.fullmatch(_WORD, name) is not None and not _RESERVED.search(name)


def column(name: object, what: str = "column") -> str:
    if not is_column(name):
        raise InvalidArgument(f"invalid {what} name: {name!r}")
    return name


def table_and_alias(text: object, what: str = "relation") -> tuple[str, str]:
    """The name and alias in ``table``, ``table alias`` or ``table AS alias``."""
    words = text.replace("`", "").replace('"', "").split() if isinstance(text, str) else []
    if len(words) == 3 and words[1].upper() == "AS":
        words = [words[0], words[2]]
    if len(words) not in (1, 2) or not all(map(is_table, words)):
        raise InvalidArgument(f"invalid {what}: {text!r}")
    return words[0], words[-1]


def relation(given: object, default: str | None = None) -> tuple[object, str, str | None]:
    """Source, the name it is read under, and the name of the result (None: not given).

    ``given`` is a relation string, a frame or query, or a mapping of one such to the result's name.
    """
    result = default
    if isinstance(given, Mapping):
        if len(given) != 1:
            raise InvalidArgument("a relation mapping has one entry")
        given, result = next(iter(given.items()))
        if not is_table(result):
            raise InvalidArgument(f"invalid relation alias: {result!r}")
    if isinstance(given, str):
        name, alias = table_and_alias(given)
        return name, alias, result
    return given, result or "derived", result


def keys(given: object, what: str) -> list[str]:
    names = [given] if isinstance(given, str) else list(given) if isinstance(given, Iterable) else []
    if not names:
        raise InvalidArgument(f"no {what}")
    return [column(n, what) for n in names]


def key_pairs(foreign: object, local: object) -> tuple[list[str], list[str]]:
    f, l = keys(foreign, "foreign key"), keys(local, "local key")
    if len(f) != len(l):
        raise InvalidArgument("as many local keys as foreign keys are needed")
    return f, l


def bare(name: str) -> str:
    return name.rpartition(".")[2]


def protected(text: str, prefixed: Callable[[str], str] = str) -> str:
    """``a.b AS c`` with each name in backquotes; a star, numbers, calls and text in quotes stay as they are."""
    words = text.split()
    if len(words) == 3 and words[1].upper() == "AS":
        return f"{protected(words[0], prefixed)} AS `{words[2]}`"
    if len(words) == 2:
        return f"{protected(words[0], prefixed)} `{words[1]}`"
    if len(words) != 1 or re.search(r"[('\"]", text):
        return text
    parts = [p.strip("`") for p in text.split(".")]
    parts[:-1] = [*parts[:-2], prefixed(parts[-2])] if len(parts) > 1 else []
    return ".".join(p if p == "*" or p.isdigit() else f"`{p}`" for p in parts)


def split_list(text: str) -> list[str]:
    """Comma-separated parts; commas in brackets or quotes don't count."""
    parts, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            parts.append(now)
            now = ""
            continue
        now += c
    return [p.strip() for p in [*parts, now] if p.strip()]
