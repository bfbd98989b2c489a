"""Text columns: search tokens, array literals, padded concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a search query ignores.
STOPWORDS = (
    "the", "a", "an", "and", "or", "for", "in", "on", "of", "to", "can", "you", "we", "have", "has",
    "where", "find", "looking", "look", "customer", "please", "that", "this", "with", "stock", "our",
)

# Spoken sizes and the size codes they stand for; "extra" is dropped.
SIZE_ALIASES = {
    "small": "s",
    "sm": "s",
    "medium": "m",
    "med": "m",
    "large": "l",
    "lg": "l",
    "xlarge": "xl",
    "extra": "",
}

# Size codes that match a product only through its size column.
SIZE_TOKENS = ("s", "m", "l", "xl")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, as an array."""
    spaced = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def query_tokens(query: Column) -> Column:
    """Distinct search tokens of a query in order of first use."""
    aliases = F.create_map(*[F.lit(x) for pair in SIZE_ALIASES.items() for x in pair])
    kept = F.filter(words(query), lambda w: ~w.isin(*STOPWORDS))
    mapped = F.transform(kept, lambda w: F.coalesce(F.try_element_at(aliases, w), w))
    return F.array_distinct(F.filter(mapped, lambda w: w != ""))


def product_tokens(size: Column, *texts: Column) -> Column:
    """Distinct tokens a product answers to; size codes come only from its size."""
    found = F.filter(words(F.concat_ws(" ", *texts)), lambda w: ~w.isin(*SIZE_TOKENS))
    code = F.lower(size)
    sized = F.when(code.isin(*SIZE_TOKENS), F.array(code)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, sized))


# An element is quoted, with backslash escapes, or bare up to the next comma.
_ELEMENT = r'(?s)"(?:[^"\\]++|\\.)*+"|[^,"]++'


def pg_array(text: Column) -> Column:
    """``{a,"b,c"}`` text as an array of strings; ``{}`` is the empty array and a bare ``NULL`` a null element.

    Text without braces is an error.
    """
    parts = F.regexp_extract_all(F.regexp_replace(text, r"^\{|\}$", ""), F.lit(_ELEMENT), F.lit(0))
    quoted = lambda e: F.regexp_replace(F.substr(e, F.lit(2), F.char_length(e) - 2), r"(?s)\\(.)", "$1")
    values = F.transform(
        parts, lambda e: F.when(e.startswith('"'), quoted(e)).when(F.upper(F.trim(e)) != "NULL", F.trim(e))
    )
    return F.when(text.rlike(r"(?s)^\{.*\}$"), values).when(
        text.isNotNull(), F.raise_error(F.concat(F.lit("not an array literal: "), text)).cast("array<string>")
    )


def to_pg_array(values: Column) -> Column:
    """An array of strings as ``{a,b}`` text; elements that need it are quoted, null ones are ``NULL``."""
    plain = lambda v: v.rlike(r'^[^,{}"\\\s]++$') & (F.upper(v) != "NULL")
    escaped = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
    written = F.transform(values, lambda v: F.when(v.isNull(), "NULL").when(plain(v), v).otherwise(escaped(v)))
    return F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))


def json_purchases(text: Column) -> Column:
    """JSON text of a purchase list as an array of ``{sku, qty}``."""
    return F.from_json(text, "array<struct<sku:string,qty:int>>", {"mode": "FAILFAST"})


def concat_skip_null(*parts: Column) -> Column:
    """Concatenation in which a NULL part counts as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def padded(number: Column, width: int) -> Column:
    """Number as text, zero-padded on the left."""
    return F.lpad(number.cast("string"), width, "0")
