"""A small read-only language over JSON records: SELECT * FROM <table> [WHERE a = b [AND ...]] [LIMIT n].

The statement is parsed into a Query, and that becomes a Column; no text of the user reaches Spark's SQL parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 500
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_BARE = re.compile(r"[A-Za-z0-9_.-]*")


class StatementError(ValueError):
    """A statement outside the language."""


@dataclass
class Query:
    collection: str | None = None
    table: str | None = None
    id: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    payload: dict[str, str] = field(default_factory=dict)
    limit: int = DEFAULT_LIMIT


def _outside_quotes(text: str) -> list[tuple[int, str]]:
    out, quote = [], ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            out.append((i, c))
    if quote:
        raise StatementError("a quote is not closed")
    return out


def _value(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] in "'\"":
        if text[-1] != text[0] or text[0] in text[1:-1]:
            raise StatementError(f"not a value: {text}")
        return text[1:-1]
    if not _BARE.fullmatch(text):
        raise StatementError(f"not a value: {text}")
    return text


def _keyword(text: str, word: str) -> int:
    """Where the word stands alone outside quotes, or -1."""
    free = {i for i, _ in _outside_quotes(text)}
    for m in re.finditer(rf"(?<!\S){word}(?!\S)", text, re.I):
        if m.start() in free:
            return m.start()
    return -1


def parse(statement: str) -> Query:
    """A repeated field takes its last value; an empty WHERE admits all; `x=` asks for the empty text."""
    text = statement.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not text.lower().startswith("select * from "):
        raise StatementError("only SELECT * FROM is known")
    text = text[len("select * from ") :].strip()
    m = _NAME.match(text)
    if not m:
        raise StatementError("a table name is missing")
    out, rest = Query(), text[m.end() :]
    if m[0].lower() != "records":
        out.table = m[0]
    if rest and not rest[0].isspace():
        raise StatementError(f"not a table name: {text}")
    at = _keyword(rest, "limit")
    if at >= 0:
        number = rest[at + 5 :].strip()
        if not number.isdecimal() or not number.isascii() or int(number) < 1:
            raise StatementError("LIMIT takes a number from 1")
        out.limit, rest = min(int(number), MAX_LIMIT), rest[:at]
    rest = rest.strip()
    if rest:
        if not re.match(r"where(\s|$)", rest, re.I):
            raise StatementError(f"not understood: {rest}")
        body = rest[5:].strip()
        while body:
            at = _keyword(body, "and")
            one, body = (body, "") if at < 0 else (body[:at], body[at + 3 :].strip())
            if at >= 0 and not body:
                raise StatementError("a condition is missing after AND")
            _condition(out, one.strip())
    return out


def _condition(out: Query, text: str) -> None:
    at = next((i for i, c in _outside_quotes(text) if c == "="), -1)
    if at < 1:
        raise StatementError(f"not a condition: {text}")
    name, value = text[:at].strip(), _value(text[at + 1 :])
    head, dot, key = name.partition(".")
    if dot and head.lower() in ("metadata", "payload"):
        if not key or not re.fullmatch(r"[A-Za-z0-9_.-]+", key):
            raise StatementError(f"not a field: {name}")
        getattr(out, head.lower())[key] = value
    elif not _NAME.fullmatch(name):
        raise StatementError(f"not a field: {name}")
    elif name.lower() in ("collection", "table", "id"):
        setattr(out, name.lower(), value)
    else:
        out.payload[name] = value


def scalar_text(payload: Column, key: str) -> Column:
    """Text of a top-level scalar of a JSON object: "null" for null, no value for a missing key, an array or an object.

    payload is JSON text; a number has the text in which it is written again (1.50 is 1.5).
    """
    raw = F.from_json(payload, "map<string,string>", {"primitivesAsString": "true"})[key]
    variant = F.try_parse_json(payload)
    path = "$[" + "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'" + "]"
    piece = F.try_variant_get(variant, F.lit(path), "variant")
    kind = F.schema_of_variant(piece)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(F.is_variant_null(piece), F.lit("null")).when(piece.isNotNull() & ~nested, raw)


def predicate(q: Query) -> Column:
    out = F.lit(True)
    for name in ("collection", "table", "id"):
        if getattr(q, name) is not None:
            out = out & (F.col(name) == getattr(q, name))
    for key, value in q.metadata.items():
        out = out & F.coalesce(F.col("metadata")[key] == value, F.lit(False))
    for key, value in q.payload.items():
        out = out & F.coalesce(scalar_text(F.col("payload"), key) == value, F.lit(False))
    return out


def execute(records: DataFrame, tenant: str, statement: str, order: str = "seq") -> DataFrame:
    """The tenant's records that the statement asks for, in insertion order of their latest write."""
    q = parse(statement)
    return records.where((F.col("tenant_id") == tenant) & predicate(q)).orderBy(order).limit(q.limit)
