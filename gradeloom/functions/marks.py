"""Reading one mark cell."""

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.numeric import _let, fmt_g
from gradeloom.functions.text import strip

# The words that stand for a missing mark.
ABSENT_WORDS = ("a", "ab", "absent", "abs")
EXEMPT_WORDS = ("e", "ex", "exempt")

# Number words and digits as a decimal float is written; underscores may
# separate digits.
_DIGITS = r"\d+(?:_\d+)*"
FLOAT_PATTERN = (
    rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)

_PLAIN = r"\A[0-9]{1,15}(?:\.[0-9]{1,15})?\z"


# Every decimal digit of any script, in the order 0 to 9 of each.
_FOREIGN = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)


def plain_digits(token: Column) -> Column:
    """``token`` with the decimal digits of every script as 0 to 9."""
    return F.when(token.rlike(r"\p{Nd}") & token.rlike(r"[^\x00-\x7F]"), F.translate(token, _FOREIGN, _VALUES)).otherwise(token)


def read_float(token: Column) -> Column:
    """The double written in lower-case ``token``, NULL when it is no number.

    The pattern decides what a number is (a plain cast would take ``1d`` and
    refuse ``1_000``); the cast only converts. Short plain decimals are cast at once.
    """
    return F.when(token.rlike(_PLAIN), token.try_cast("double")).otherwise(_read_float(token))


def _read_float(token: Column) -> Column:
    token = plain_digits(token)
    digits = F.translate(token, "_", "")
    magnitude = F.regexp_replace(digits, r"^[+-]?(inf|infinity)$", "Infinity")
    value = (
        F.when(digits.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(magnitude == "Infinity", F.when(digits.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(digits.try_cast("double"))
    )
    return F.when(token.rlike(FLOAT_PATTERN), value)


def parse_mark(value: Column, kind: Column, max_marks: Column) -> Column:
    """A cell as STRUCT(status, obtained, problem); all NULL for a blank cell.

    ``kind`` tells how the sheet stored the value: blank, text, int, float,
    bool or date. With a ``problem`` (unreadable, negative or over),
    ``obtained`` is the number that was read.
    """
    return _let(F.lower(strip(value)), lambda token: _mark(value, kind, max_marks, token))


def _mark(value: Column, kind: Column, max_marks: Column, token: Column) -> Column:
    is_text = kind == "text"
    is_blank = value.isNull() | (kind == "blank") | (is_text & (token == ""))
    word = F.when(is_text & token.isin(*ABSENT_WORDS), "absent").when(is_text & token.isin(*EXEMPT_WORDS), "exempt")
    read = (
        F.when(is_blank | word.isNotNull(), F.lit(None).cast("double"))
        .when(kind == "bool", F.when(token == "true", 1.0).when(token == "false", 0.0).otherwise(token.try_cast("double")))
        .when(kind == "date", F.lit(None).cast("double"))
        .otherwise(read_float(token))
    )

    def judged(number: Column) -> Column:
        over = ~F.isnan(number) & (number > max_marks) & ~F.isnan(max_marks)
        problem = (
            F.when(is_blank | word.isNotNull(), F.lit(None))
            .when(number.isNull(), F.lit("unreadable"))
            .when(number < 0, F.lit("negative"))
            .when(over, F.lit("over"))
        )
        status = F.when(is_blank | problem.isNotNull(), F.lit(None)).otherwise(F.coalesce(word, F.lit("entered")))
        obtained = F.when(is_blank, F.lit(None)).when(word.isNotNull(), F.lit(0.0)).otherwise(number)
        return F.struct(status.alias("status"), obtained.alias("obtained"), problem.alias("problem"))

    return _let(read, judged)


def problem_text(problem: Column, value: Column, number: Column, max_marks: Column) -> Column:
    """The message for a problem found by ``parse_mark``."""
    return (
        F.when(problem == "unreadable", F.concat(F.lit("unrecognised mark value '"), value, F.lit("'")))
        .when(problem == "negative", F.lit("marks cannot be negative"))
        .when(problem == "over", F.concat(F.lit("mark "), fmt_g(number), F.lit(" exceeds maximum "), fmt_g(max_marks)))
    )
