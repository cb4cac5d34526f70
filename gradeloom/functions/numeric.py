"""Rounding, summing and number formats that agree with IEEE doubles exactly."""

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DECIMALS = 8
_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves
_STEP = 4294967296.0  # 2**32, distance between the pieces of an exact sum
_EXACT = 9007199254740992.0  # 2**53, up to here every integer is a double


def _let(value: Column, body) -> Column:
    """``body(value)`` where the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """What the rounded ``product`` of two doubles lacks to the exact one."""
    carry_a, carry_b = F.lit(_SPLITTER) * a, F.lit(_SPLITTER) * b
    high_a, high_b = carry_a - (carry_a - a), carry_b - (carry_b - b)
    low_a, low_b = a - high_a, b - high_b
    return low_a * low_b - (((product - high_a * high_b) - low_a * high_b) - high_a * low_b)


# --- rounding ------------------------------------------------------------------


def _power_of_ten(digits) -> Column:
    if isinstance(digits, int):
        if not 0 <= digits <= MAX_DECIMALS:
            raise ValueError(f"decimals must be between 0 and {MAX_DECIMALS}")
        return F.lit(float(10**digits))
    powers = F.array(*[F.lit(float(10**n)) for n in range(MAX_DECIMALS + 1)])
    # element_at fails loudly for decimals outside the supported range
    return F.element_at(powers, digits + F.lit(1))


def py_round(x: Column, digits) -> Column:
    """Round to ``digits`` decimals, half to even on the exact binary value.

    ``x * 10**digits`` may land on a tie only because the product was rounded;
    the rounding error of the product then tells on which side of the tie the
    exact value lies. Where the product is too large to be exact as an integer,
    what ``x`` has beyond an integer is rounded by itself: it has few bits there. Written
    without branches, so that generated code holds every shared part once.
    """
    scale = _power_of_ten(digits)
    large = ((F.abs(x) * scale >= _EXACT) & (F.abs(x) < F.lit(float("inf")))).cast("double")
    whole = F.nanvl(F.rint(x) * large, F.lit(0.0))  # 0 unless the number is large
    return whole + _scaled_integer(x - whole, scale) / scale


def _scaled_integer(part: Column, scale: Column) -> Column:
    """The integer nearest to the exact ``part * scale``, half to even; both are small enough for it."""
    product = part * scale
    nearest = F.rint(product)
    carry = F.lit(_SPLITTER) * part
    high = carry - (carry - part)
    error = (high * scale - product) + (part - high) * scale
    # -1 or +1 exactly when a tie was rounded away from the side of the error
    excess = (nearest - product) - F.signum(error) * 0.5
    return nearest - F.coalesce(excess.try_cast("int"), F.lit(0))


# --- sums ----------------------------------------------------------------------


def exact_sums(df: DataFrame, keys: list[str], sums: dict[str, Column], more: dict[str, tuple] | None = None) -> DataFrame:
    """Group ``df`` by ``keys`` and sum doubles, correctly rounded, in any row order.

    Each value is cut into three integer pieces of 32 bits within a window of
    exponents; windows of all exponents of a double exist. Pieces are summed as
    BIGINT by (keys, sum, window), which combines map-side and does not depend on the
    order of rows, and the few windows of a group are joined with one rounding. A
    group may hold any magnitudes and 2**30 values for each window. NULL is ignored;
    no value sums to 0; infinities and NaN add as doubles do. Several sums become rows
    of their own first, so the windows of one never multiply with those of another.

    ``more`` names further aggregates, which must ignore NULL, as (column for the first grouping,
    function of its name for the second), such as (F.count("*"), F.sum).
    """
    more = more or {}
    values = [value.cast("double") for value in sums.values()]
    if len(values) == 1:
        each = df.select("*", F.lit(0).alias("_sum_no"), values[0].alias("_sum_x"))
    else:
        each = df.select("*", F.posexplode(F.array(*values)).alias("_sum_no", "_sum_x"))
    infinite = "abs(_sum_x) = double('infinity')"
    usual = f"coalesce(_sum_x <> 0D AND NOT isnan(_sum_x) AND NOT {infinite}, false)"
    cut = each.selectExpr("*", f"CAST(floor(log2(CASE WHEN {usual} THEN abs(_sum_x) ELSE 1D END) / 32) AS INT) AS _sum_w")
    half = "power(2D, _sum_w * -16)"
    cut = cut.selectExpr("*", f"CASE WHEN {usual} THEN _sum_x * {half} * {half} ELSE 0D END AS _sum_m")
    cut = cut.selectExpr("*", f"(_sum_m - CAST(CAST(_sum_m AS BIGINT) AS DOUBLE)) * {_STEP}D AS _sum_r")
    once = cut.groupBy(*keys, "_sum_no", "_sum_w").agg(
        F.expr("sum(CAST(_sum_m AS BIGINT)) AS _p"),
        F.expr("sum(CAST(_sum_r AS BIGINT)) AS _q"),
        F.expr(f"sum(CAST((_sum_r - CAST(CAST(_sum_r AS BIGINT) AS DOUBLE)) * {_STEP}D AS BIGINT)) AS _l"),
        F.expr(f"sum(CASE WHEN isnan(_sum_x) OR {infinite} THEN _sum_x END) AS _s"),
        *[agg.alias(name) for name, (agg, _) in more.items()],
    )
    parts = F.expr("""CASE WHEN _p <> 0 OR _q <> 0 OR _l <> 0 OR _s IS NOT NULL
                      THEN struct(_sum_no AS n, _sum_w AS w, _p AS p, _q AS q, _l AS l, _s AS s) END""")
    # every row of the input is there once for each sum; what else is asked is taken from the first
    further = [F.when(F.col("_sum_no") == 0, F.col(name)).alias(name) for name in more]
    twice = once.select(*keys, parts.alias("_a"), *further).groupBy(*keys).agg(
        F.collect_list("_a").alias("_a"), *[again(name).alias(name) for name, (_, again) in more.items()]
    )

    special = "get(filter(transform(windows, a -> a.s), s -> s IS NOT NULL), 0)"
    one = _bind("filter(_a, a -> a.n = sum_no)", "windows", f"coalesce({special}, {_single()}, {_joined()}, 0D)")
    every = F.expr(f"transform(sequence(0, {len(sums) - 1}), sum_no -> {one})")
    totals = twice.select(*keys, every.alias("_a"), *more)
    return totals.select(*keys, *[F.get("_a", n).alias(name) for n, name in enumerate(sums)], *more)


def _bind(value: str, name: str, body: str) -> str:
    """SQL of ``body`` where ``name`` stands for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _carried(places: str) -> str:
    """SQL of the digits to base 2**32 of an array of places, from the lowest to the highest, the last one signed."""
    return f"""aggregate({places}, struct(CAST(array() AS ARRAY<BIGINT>) AS done, 0L AS carry),
        (state, place) -> struct(concat(state.done, array((state.carry + place) & 4294967295L)) AS done,
                                 shiftright(state.carry + place, 32) AS carry),
        state -> concat(state.done, array(state.carry)))"""


def _added(a: str, b: str, c: str) -> str:
    """SQL of the double nearest to a * 2**64 + b * 2**32 + c, all three doubles of at most 32 bits."""
    three = f"struct({a} * {_STEP * _STEP}D AS a, {b} * {_STEP}D AS b, {c} AS c)"
    return _bind(three, "three", _bind("three.a + three.b", "s", "s + ((three.b - (s - three.a)) + three.c)"))


def _single() -> str:
    """SQL of ``_joined`` for the usual case, one window with a small sum that is not negative; else NULL."""
    half = "power(2D, (one.w - 2) * 16)"
    b, c = "CAST(middle & 4294967295L AS DOUBLE)", "CAST(one.l & 4294967295L AS DOUBLE)"
    fits = f"CASE WHEN whole >= 0 AND whole < 4294967296L THEN {_added('CAST(whole AS DOUBLE)', b, c)} * {half} * {half} END"
    carried = _bind("one.q + shiftright(one.l, 32)", "middle", _bind("one.p + shiftright(middle, 32)", "whole", fits))
    return f"CASE WHEN size(windows) = 1 THEN {_bind('get(windows, 0)', 'one', carried)} END"


def _joined() -> str:
    """SQL of the double nearest to the sum of the pieces of all ``windows``.

    Written as text, since a Column of this size takes half a second to build.
    """
    at = """aggregate(windows, 0L, (total, a) -> total
        + coalesce(CASE a.w WHEN place THEN a.p WHEN place + 1 THEN a.q WHEN place + 2 THEN a.l END, 0L))"""
    span = "struct(array_min(transform(windows, a -> a.w)) - 2 AS low, array_max(transform(windows, a -> a.w)) AS high)"
    signed = _carried(f"transform(sequence(span.low, span.high), place -> {at})")
    size = f"CASE WHEN element_at(done, -1) < 0 THEN {_carried('transform(done, d -> -d)')} ELSE done END"
    # position of the first digit that counts, from 0; it and the next two are joined, and whether any digits follow
    top = "size(digits) - CAST(array_position(reverse(transform(digits, d -> d <> 0)), true) AS INT)"
    a, b, c = (f"CAST(coalesce(get(digits, top - {k}), 0L) AS DOUBLE)" for k in range(3))
    rest = "exists(slice(digits, 1, greatest(top - 2, 0)), d -> d <> 0)"
    # an even last digit is moved by one where digits follow: far below the last bit, but off the tie
    total = _added(a, b, f"{c} + CASE WHEN {rest} AND {c} % 2D = 0D THEN 1D ELSE 0D END")
    half = "power(2D, (span.low + top - 2) * 16)"
    sign = "CASE WHEN element_at(done, -1) < 0 THEN -1D ELSE 1D END"
    nearest = f"CASE WHEN top = size(digits) THEN 0D ELSE {sign} * {total} * {half} * {half} END"
    return _bind(span, "span", _bind(signed, "done", _bind(size, "digits", _bind(top, "top", nearest))))


# --- text ----------------------------------------------------------------------


_LIMB = 10**9  # digits of a large integer are kept to this base
_SHIFT = 28  # powers of two that a limb takes at once without leaving 64 bits


def integer_text(size: Column) -> Column:
    """All digits of a finite double that is a non-negative integer.

    From 2**53 on the integer is mantissa * 2**k; its limbs are multiplied by powers of two
    and carried, so the digits are those of the exact binary value.
    """

    def limbs(state: Column, power: Column) -> Column:
        def step(sofar, limb):
            total = limb * power + sofar["carry"]
            return F.struct(F.concat(sofar["done"], F.array(total % _LIMB)).alias("done"), F.floor(total / F.lit(_LIMB).cast("decimal(20,0)")).cast("bigint").alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry"))
        return F.aggregate(state, start, step, lambda s: F.when(s["carry"] > 0, F.concat(s["done"], F.array(s["carry"]))).otherwise(s["done"]))

    def exact(k: Column) -> Column:
        mantissa = (size / F.pow(F.lit(2.0), k)).cast("bigint")  # no bit is lost below 2**63
        first = F.array(mantissa % _LIMB, F.floor(mantissa / F.lit(_LIMB).cast("decimal(20,0)")).cast("bigint"))
        shifts = F.sequence(F.lit(0), k, F.lit(_SHIFT))  # the last ones are cut to what is left
        left = lambda at: F.least(F.lit(_SHIFT), k - at)
        power = lambda at: F.pow(F.lit(2.0), left(at)).cast("bigint")
        digits = F.aggregate(shifts, first, lambda state, at: limbs(state, power(at)))
        padded = F.transform(F.reverse(digits), lambda limb: F.lpad(limb.cast("string"), 9, "0"))
        return F.regexp_replace(F.array_join(padded, ""), "^0+", "")

    exponent = F.greatest(F.lit(0), F.floor(F.log2(size)).cast("int") - 53)
    return F.when(size < _EXACT, size.cast("bigint").cast("string")).otherwise(_let(exponent, exact))


def fmt_f(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals (``-``/``nan``/``inf`` included), as C's ``%.Nf``:
    the decimals are those of the exact binary value, half to even, at every magnitude."""
    size = F.abs(x)
    scale = _power_of_ten(digits)

    def written(parts: Column) -> Column:
        if not digits:
            return integer_text(parts["whole"] + F.when((parts["whole"] < _EXACT) & (parts["fraction"] != 0.5), parts["units"])
                                .when((parts["fraction"] == 0.5) & (parts["whole"] % 2.0 == 1.0), F.lit(1.0)).otherwise(F.lit(0.0)))
        up = (parts["units"] >= scale).cast("double")
        tail = F.lpad((parts["units"] - up * scale).cast("bigint").cast("string"), digits, "0")
        return F.concat(integer_text(parts["whole"] + up), F.lit("."), tail)

    def split(whole: Column) -> Column:
        fraction = size - whole
        return _let(F.struct(whole.alias("whole"), fraction.alias("fraction"), _scaled_integer(fraction, scale).alias("units")), written)

    finite = F.when(size < F.lit(float("inf")), F.floor(size / 1.0).cast("double"))
    whole = F.when(size < _EXACT, finite).otherwise(size)
    sign = F.when((x < 0) | ((x == 0.0) & x.cast("string").startswith("-")), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(F.concat(sign, _let(whole, split)))
    )


_DIGITS = 6
_DEEPEST, _HIGHEST = -324, 308  # decimal exponents of doubles


def _scaled_power(exponent: int) -> tuple[float, float]:
    """10**exponent as the sum of two doubles, scaled to keep clear of the ends of the range:
    times 2**-600 for positive exponents, which meet small numbers, 2**-200 for the others' inverse."""
    exact = Fraction(10) ** abs(exponent) / Fraction(2) ** (600 if exponent > 0 else 200)
    return float(exact), float(exact - Fraction(float(exact)))


def fmt_g(x: Column) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g``.

    The digits are the integer nearest to x * 10**k, half to even; the product or,
    for large numbers, the remainder is carried in two doubles, so that they
    are those of the exact binary value at every magnitude.
    """
    size = F.abs(x)
    usual = F.coalesce((size > 0) & (size < F.lit(float("inf"))), F.lit(False))
    text = _let(F.when(usual, size).otherwise(F.lit(1.0)), lambda v: _let(_exponent(v), lambda e: _general(v, e)))
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .when(x == 0.0, F.when(x.cast("string").startswith("-"), F.lit("-0")).otherwise(F.lit("0")))
        .when(x < 0, F.concat(F.lit("-"), text))
        .otherwise(text)
    )


def _at_least(exponent: int) -> float:
    """The least double that is not below 10**exponent."""
    near = float(f"1e{exponent}")
    return near if Fraction(near) >= Fraction(10) ** exponent else math.nextafter(near, math.inf)


def _exponent(size: Column) -> Column:
    """The decimal exponent of the first digit."""
    powers = F.array(*[F.lit(_at_least(k)) for k in range(_DEEPEST, _HIGHEST + 1)])
    guess = F.greatest(F.lit(_DEEPEST), F.least(F.lit(_HIGHEST), F.floor(F.log10(size)).cast("int")))
    above = F.coalesce(F.get(powers, guess + (1 - _DEEPEST)), F.lit(float("inf")))
    return F.when(size >= above, guess + 1).when(size < F.get(powers, guess - _DEEPEST), guess - 1).otherwise(guess)


def _general(size: Column, exponent: Column) -> Column:
    shifts = range(_DIGITS - 1 - _HIGHEST, _DIGITS - 1 - _DEEPEST + 2)
    highs, lows = zip(*(_scaled_power(k) for k in shifts))
    shift = F.lit(_DIGITS - 1) - exponent
    power = F.struct(
        F.get(F.array(*map(F.lit, highs)), shift - shifts[0]).alias("high"), F.get(F.array(*map(F.lit, lows)), shift - shifts[0]).alias("low")
    )

    def rounded(p: Column) -> Column:
        return F.when(shift > 0, _small(size, p)).otherwise(_large(size, p))

    def written(n: Column) -> Column:
        full = n == 10**_DIGITS
        digits = F.when(full, F.lit("1")).otherwise(F.regexp_replace(n.cast("string"), "0+$", ""))
        return _let(F.struct(digits.alias("d"), (exponent + full.cast("int")).alias("e")), lambda s: _placed(s["d"], s["e"]))

    return _let(_let(power, rounded).cast("bigint"), written)


def _half_even(nearest: Column, rest: Column) -> Column:
    """``nearest`` moved by one if the rest beyond it, in units, is over a half, or a half and it is odd."""
    odd = F.abs(nearest) % 2.0 == 1.0
    up = (rest > 0.5) | ((rest == 0.5) & odd)
    down = (rest < -0.5) | ((rest == -0.5) & odd)
    return nearest + F.when(up, F.lit(1.0)).when(down, F.lit(-1.0)).otherwise(F.lit(0.0))


def _small(size: Column, power: Column) -> Column:
    """size * 10**shift to an integer."""
    scaled = size * F.lit(2.0**600)
    high, low = power["high"], power["low"]

    def settle(product: Column) -> Column:
        nearest = F.rint(product)
        return _half_even(nearest, (product - nearest) + (_product_error(scaled, high, product) + scaled * low))

    return _let(scaled * high, settle)


def _large(size: Column, power: Column) -> Column:
    """size / 10**-shift to an integer, by its remainder."""
    scaled = size * F.lit(2.0**-200)
    high, low = power["high"], power["low"]

    def settle(nearest: Column) -> Column:
        def by(product: Column) -> Column:
            left = ((scaled - product) - _product_error(nearest, high, product)) - nearest * low
            # A half is compared without division: left against half the power.
            odd = nearest % 2.0 == 1.0
            over, under = (left - high * 0.5) - low * 0.5, (left + high * 0.5) + low * 0.5
            up = (over > 0) | ((over == 0) & odd)
            down = (under < 0) | ((under == 0) & odd)
            return nearest + F.when(up, F.lit(1.0)).when(down, F.lit(-1.0)).otherwise(F.lit(0.0))

        return _let(nearest * high, by)

    return _let(F.rint(scaled / high), settle)


def _placed(digits: Column, exponent: Column) -> Column:
    """Digits with a point, or in scientific notation."""
    length = F.length(digits)
    tail = F.substring(digits, F.lit(2), length)
    point = F.when(length > 1, F.concat(F.lit("."), tail)).otherwise(F.lit(""))
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    power = F.abs(exponent)
    science = F.concat(F.substring(digits, 1, 1), point, F.lit("e"), sign, F.when(power < 10, F.lit("0")).otherwise(F.lit("")), power.cast("string"))
    whole = F.rpad(digits, F.greatest(exponent + 1, length), "0")
    above = F.substring(whole, F.lit(1), exponent + 1)
    below = F.substring(whole, exponent + 2, length)
    plain = F.concat(above, F.when(below == "", F.lit("")).otherwise(F.concat(F.lit("."), below)))
    fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits)
    return F.when((exponent < -4) | (exponent >= _DIGITS), science).when(exponent < 0, fraction).otherwise(plain)
