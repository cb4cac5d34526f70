"""Text helpers shared by import, ids and reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.numeric import integer_text

# Every code point that counts as white space.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = "[" + WHITESPACE + "]+"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, _SPACE_RUN, " ")


def safe_name(text: Column) -> Column:
    """A file-name part: letters, digits, space, ``_`` and ``-`` survive."""
    kept = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""))
    return F.translate(F.coalesce(F.nullif(kept, F.lit("")), F.lit("Student")), " ", "_")


def clean_text(value: Column, kind: Column) -> Column:
    """A cell as text: integral floats lose the fraction, NULL becomes ''."""
    number = value.try_cast("double")
    whole = (kind == "float") & (number == F.rint(number)) & (F.abs(number) < F.lit(float("inf")))
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(value.isNull(), F.lit(""))
        .when(whole, F.concat(sign, integer_text(F.abs(number))))
        .when(kind == "bool", F.initcap(value))
        .otherwise(strip(value))
    )


def normal_header(value: Column, kind: Column) -> Column:
    """Header text for comparison: cleaned, squeezed, lower case."""
    return F.lower(squeeze(clean_text(value, kind)))


def blank(value: Column) -> Column:
    """True for NULL and ''."""
    return F.coalesce(value, F.lit("")) == ""


# A template's parts: doubled braces, fields, text, and braces that stand alone.
_PART = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"
_SPEC = r"(?s)^(?:(.)?([<>^]))?(0)?([0-9]{0,9})(?:\.([0-9]{1,9}))?s?$"


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Fill a format template: ``{key}``, ``{key!s}``, ``{key:spec}``; ``{{`` and ``}}`` stand for braces.

    A spec has fill, alignment (``<``, ``>``, ``^``), width and precision, as for strings. A template with
    an unknown key, another conversion or spec, or a brace that stands alone stays as it is. Inserted
    values are never filled again.
    """
    named = F.create_map(*[c for key, value in values.items() for c in (F.lit(key), F.coalesce(value, F.lit("")))])
    parts = F.regexp_extract_all(template, F.lit(_PART), F.lit(0))

    def is_field(part: Column) -> Column:
        return part.startswith("{") & part.endswith("}")

    def key(part: Column) -> Column:
        return F.regexp_extract(part, r"^\{([^:!}]*)", 1)

    def spec(part: Column) -> Column:
        return F.regexp_extract(part, r"(?s)^\{[^:!}]*(?:!s)?:?(.*)\}$", 1)

    def bad(part: Column) -> Column:
        known = F.map_contains_key(named, key(part)) & spec(part).rlike(_SPEC) & part.rlike(r"(?s)^\{[^:!}]*(?:!s)?(?::.*)?\}$")
        return part.isin("{", "}") | (is_field(part) & ~known)

    def fill(part: Column) -> Column:
        value = _formatted(F.element_at(named, key(part)), spec(part))
        return F.when(part == "{{", F.lit("{")).when(part == "}}", F.lit("}")).when(is_field(part), value).otherwise(part)

    return F.when(template.isNull() | F.exists(parts, bad), template).otherwise(F.array_join(F.transform(parts, fill), ""))


def _formatted(value: Column, spec: Column) -> Column:
    """``value`` by a valid string format ``spec``."""
    fill, align, zero, width, precision = (F.regexp_extract(spec, _SPEC, n) for n in range(1, 6))
    cut = F.when(precision == "", value).otherwise(F.substring(value, F.lit(1), precision.try_cast("int")))
    missing = F.greatest(F.coalesce(width.try_cast("int"), F.lit(0)) - F.length(cut), F.lit(0))
    before = F.when(align == ">", missing).when(align == "^", F.floor(missing / 2).cast("int")).otherwise(F.lit(0))
    with_ = F.when(fill != "", fill).when(zero == "0", F.lit("0")).otherwise(F.lit(" "))
    return F.when(spec == "", value).otherwise(F.concat(F.repeat(with_, before), cut, F.repeat(with_, missing - before)))
