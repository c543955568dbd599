"""Text expressions: strip, whitespace, entities, numbers, dates, URLs."""

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.schemas import CATEGORY_URL

# The characters that count as whitespace in Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The entities a browser writes when it serialises a page; ``&amp;`` is last so
# that ``&amp;lt;`` decodes once.
SERIALISED_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&nbsp;", "\xa0"),
    ("&amp;", "&"),
]
_ENTITY = "&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]{1,30});"
_RARE_ENTITY = "&(?!(?:lt|gt|quot|nbsp|amp);)[#A-Za-z]"
# An entity, or what is before the next one; a lone ``&`` is text.
_PIECES = f"(?s){_ENTITY}|(?:(?!{_ENTITY}).)++"

_NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
# One literal text, so that the map is folded to a constant while planning.
_NAMED = "str_to_map('{}', '\\u0001', '\\u0002')".format(
    "\\u0001".join(f"{name}\\u0002\\u{ord(char):04x}" for name, char in _NAMES.items())
)
_DIGITS = "ltrim('0', if(p rlike '^&#[xX]', substring(p, 4, length(p) - 4), substring(p, 3, length(p) - 3)))"
# Longer numbers are out of range; none of them reaches the conversion.
_CODE = f"""cast(case when length({_DIGITS}) > 7 then '0'
    when p rlike '^&#[xX]' then conv(concat('0', {_DIGITS}), 16, 10) else concat('0', {_DIGITS}) end as int)"""
# References to the control characters 128 to 159 mean those of code page 1252, as HTML has it.
_PAGE_1252 = {c: t for c in range(128, 160) if (t := bytes([c]).decode("cp1252", "ignore"))}
_CONTROLS = "str_to_map('{}', '\\u0001', '\\u0002')".format("\\u0001".join(f"{c}\\u0002\\u{ord(t):04x}" for c, t in _PAGE_1252.items()))
# The pieces of a text are entities or the text between them.
_DECODE_PIECE = f"""p -> case
    when not p rlike '^{_ENTITY}$' then p
    when p not like '&#%' then coalesce(try_element_at({_NAMED}, substring(p, 2, length(p) - 2)), p)
    when {_CODE} between 128 and 159 and try_element_at({_CONTROLS}, cast({_CODE} as string)) is not null
        then try_element_at({_CONTROLS}, cast({_CODE} as string))
    when {_CODE} between 1 and 55295 or {_CODE} between 57344 and 1114111
        then decode(unhex(lpad(hex({_CODE}), 8, '0')), 'UTF-32')
    else '\\ufffd' end"""


def strip(text: Column) -> Column:
    """Remove whitespace, no-break spaces included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalize_space(text: Column) -> Column:
    """XPath ``normalize-space``: collapse runs of ASCII whitespace, then trim."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def decode_entities(text: Column) -> Column:
    """Decode character references, each of them once.

    A text without ``&`` is returned as it is, one with only the entities a
    browser writes takes plain replacements, and only the rest is split.
    """
    plain = text
    for entity, char in SERIALISED_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), 0)
    full = F.array_join(F.call_function("transform", pieces, F.expr(_DECODE_PIECE)), "")
    return F.when(~F.contains(text, F.lit("&")), text).when(~F.rlike(text, F.lit(_RARE_ENTITY)), plain).otherwise(full)


def is_number(text: Column) -> Column:
    """True for a text of ASCII digits only; NULL is not a number."""
    return F.coalesce(F.rlike(text, F.lit("^[0-9]+$")), F.lit(False))


def to_number(text: Column) -> Column:
    """Text of ASCII digits to int; anything else, or too large, is NULL."""
    return F.when(is_number(text), text.try_cast("int"))


def pub_date(text: Column) -> Column:
    """The day written as ``dd/MM/yyyy``; anything else is NULL."""
    return F.try_to_date(text, "dd/MM/yyyy")


def json_field(document: Column, path: str) -> Column:
    """A field of a JSON text by its dotted path, for example ``product.id``."""
    return F.get_json_object(document, f"$.{path}")


def category_url(category_id: Column) -> Column:
    return F.format_string(CATEGORY_URL, category_id.cast("string"))


def first_line(text: Column) -> Column:
    """First line of an error text."""
    return F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", 2)[0]


def run_stamp(ts: Column) -> Column:
    """Timestamp as the sortable text used in logs and run names."""
    return F.date_format(ts, "yyyyMMddHHmmss")
