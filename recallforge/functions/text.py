"""Text functions as Column expressions: tokens, chunks, query normalisation, hashes and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is neither alphabetic nor a number separates tokens.
TOKEN_BREAK = r"[^\p{IsAlphabetic}\p{N}]++"
#: Unicode white space.
SPACE = r"[\s\x0B\x85\p{Z}]+"
CHUNK_TOKENS = 48
#: Query words that stand for another one. Fixed values.
SYNONYMS = {
    "postgres": "postgresql", "postgress": "postgresql", "conexao": "connection", "conexão": "connection",
    "connections": "connection", "conectar": "connection", "conecta": "connection",
}


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row however often use mentions it.

    Column expressions are written out wherever they are mentioned, also inside lambdas, where they would be computed again for each
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """Lower-case tokens; split before lower-casing, as lower case may add combining marks."""
    return F.transform(F.filter(F.split(text, TOKEN_BREAK), lambda t: t != ""), F.lower)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, TOKEN_BREAK), lambda t: t != ""))


def normalised_query(text: Column) -> Column:
    """Tokens with synonyms replaced, joined by a space. Only queries are normalised, never documents."""
    pairs = [F.lit(x) for pair in SYNONYMS.items() for x in pair]
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.create_map(*pairs)[t], t)), " ")


def query_tokens(text: str) -> list[str]:
    """Distinct normalised tokens of a query given as a Python string, sorted."""
    import regex

    found = [t.lower() for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", text) if t]
    return sorted({SYNONYMS.get(t, t) for t in found})


def chunks(text: Column, size: int = CHUNK_TOKENS) -> Column:
    """Groups of `size` white-space words, each joined by one space; none for a blank text."""
    def cut(words: Column) -> Column:
        count = F.ceil(F.size(words) / size).cast("int")
        made = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))
        return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, SPACE), lambda t: t != ""), cut)


def approx_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def snippet(text: Column, length: int = 120) -> Column:
    return F.substring(text, 1, length)


def checksum(text: Column) -> Column:
    """CRC-32 as eight lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.crc32(F.encode(text, "UTF-8")))), 8, "0")


def mime(content_type: Column) -> Column:
    """Media type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def code_language(content_type: Column) -> Column:
    """Language of a text/x-... or application/x-... media type, else null."""
    found = F.regexp_extract(mime(content_type), "^(?:text|application)/x-(.+)$", 1)
    return F.when(found != "", found)


def render_prompt(template: Column, context: Column, query: Column) -> Column:
    """{{context}} first, then {{query}}, also where the context holds it."""
    return F.replace(F.replace(template, F.lit("{{context}}"), context), F.lit("{{query}}"), query)


def parse_vector(text: Column) -> Column:
    """"0.1,0.2" as an array of floats; null where a part is not a number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def parse_pairs(text: Column) -> Column:
    """One "key=value", split at the first =, as a map; null without = or with an empty key."""
    at = F.instr(text, "=")
    return F.when(at > 1, F.create_map(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))))
