"""Column functions over numbers, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_label(start: Column, end: Column, fiscal: Column | None = None) -> Column:
    """What a period is called: a day, a year (with the name of a fiscal one, if that is not null), a quarter or its two ends. A null start is an instant."""
    named = F.lit("") if fiscal is None else F.coalesce(F.concat(F.lit("fiscal "), fiscal.cast("string"), F.lit(", ")), F.lit(""))
    day = lambda c: F.date_format(c, "MMMM d, yyyy")
    days = F.datediff(end, start)
    return (
        F.when(start.isNull(), F.concat(F.lit("as of "), day(end)))
        .when(days == 0, F.concat(F.lit("on "), day(end)))
        .when(days.between(350, 380), F.concat(named, F.lit("year ended "), day(end)))
        .when(days.between(85, 95), F.concat(F.lit("three months ended "), day(end)))
        .otherwise(F.concat(day(start), F.lit(" to "), day(end)))
    )


def fiscal_year(end: Column, focus_year: int, focus_end: str, near: int = 7) -> Column:
    """The fiscal year that ends within `near` days of `end`, within ten years of the focus; else null."""
    out = F.lit(None).cast("int")
    for k in range(10, -11, -1):
        target = F.add_months(F.lit(focus_end).cast("date"), 12 * k)
        out = F.when(F.abs(F.datediff(end, target)) <= near, F.lit(focus_year + k)).otherwise(out)
    return out


def years_duration(years: Column) -> Column:
    """Years with a fraction as PnYnMnD; a month is 30.4375 days."""
    y = years.cast("decimal(20,6)")
    whole = F.floor(y)
    months = (y - whole) * 12
    m = F.floor(months)
    d = F.floor((months - m) * F.lit("30.4375").cast("decimal(8,4)"))
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
    spoken = F.concat(part(whole, "Y"), part(m, "M"), part(d, "D"))
    return F.concat(F.lit("P"), F.coalesce(F.nullif(spoken, F.lit("")), F.lit("0Y")))


def rounds_to(figure: Column, scale: Column, source: Column) -> Column:
    """Whether a source figure, in ones, thousands or millions, rounds to a figure over 0 of a scale (a million, a billion)
    at the figure's decimals, half away from zero. Exact; figures are as printed, with commas."""
    exact = lambda c: F.regexp_replace(c, ",", "").cast("decimal(24,6)")
    tens = F.array(*(F.lit(10**k).cast("decimal(9,0)") for k in range(7)))
    ten = tens[F.least(F.length(F.regexp_extract(figure, r"\.(\d+)$", 1)), F.lit(6))]
    said = F.lit(False)
    for unit in (1, 1000, 1_000_000):
        # |source x unit x 10^d / scale - figure x 10^d| is at most a half, and less on the far side.
        left = exact(source).cast("decimal(18,2)") * F.lit(unit).cast("decimal(7,0)") * ten
        right = exact(figure).cast("decimal(16,6)") * ten * scale.cast("decimal(10,0)")
        apart = (left - right) * 2
        said = said | ((apart >= -scale) & (apart < scale))
    return (exact(figure) > 0) & said


def rounds_thousandths(figure: Column, source: Column) -> Column:
    """Whether a thousandth of a source figure, taken as a double, rounds to a figure at its decimals, half to even.

    Only where the decimal value is half-way does the double's binary value matter: which side of it the double lies on
    is the sign of source - 1000 x double, exact as the double is split into two parts of 26 bits.
    """
    plain = lambda c: F.regexp_replace(c, ",", "")
    v = plain(source).cast("double")
    d = v / 1000
    high = d * 134217729.0 - (d * 134217729.0 - d)
    side = (v - high * 1000) - (d - high) * 1000  # over 0: the double lies below
    tens = F.array(*(F.lit(10**k).cast("decimal(7,0)") for k in range(7)))
    ten = tens[F.least(F.length(F.regexp_extract(figure, r"\.(\d+)$", 1)), F.lit(6))]
    said = plain(figure).cast("decimal(18,6)") * ten
    apart = (plain(source).cast("decimal(18,3)") * ten - said * 1000) * 2  # in thousandths: source is above by that, doubled
    even = said % 2 == 0
    return F.when(F.abs(apart) < 1000, True).when(apart == 1000, (side > 0) | ((side == 0) & even)).when(apart == -1000, (side < 0) | ((side == 0) & even)).otherwise(False)


def printed_amount(text: Column) -> Column:
    """struct(value, unit) of a printed amount: `$`, commas and spaces dropped, parentheses negative, the unit that of its last digit; null if it is none."""
    bare = F.regexp_replace(text, r"[$,  ]", "")
    digits = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
    sign = F.when(bare.rlike(r"^\(.*\)$"), -1).otherwise(1)
    places = F.length(F.regexp_extract(digits, r"\.(\d*)$", 1))
    value = (digits.cast("decimal(28,8)") * sign).cast("decimal(28,8)")
    return F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.struct(value.alias("value"), F.pow(F.lit(10.0), -places).cast("decimal(18,8)").alias("unit")))


#: Number words by their value, and tens from twenty.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
TENS_WORDS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
#: Fixed pattern: a number with points for decimals and commas or spaces between groups.
DOT_DECIMAL = r"^\d{1,3}(?:[,  ]?\d{3})*(?:\.\d+)?$|^\d+(?:\.\d+)?$"
_DECIMAL = "decimal(28,8)"


def _local(code: Column) -> Column:
    return F.lower(F.regexp_replace(code, "^[^:]*:", ""))


def _refused(what: str, text: Column, kind: str = _DECIMAL) -> Column:
    return F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(text, F.lit("null")))).cast(kind)


def spoken_number(text: Column) -> Column:
    """A number in digits or in words to twenty; `no` and `none` are 0; anything else raises."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    digits = F.regexp_replace(t, ",", "")
    place = F.array_position(F.array(*(F.lit(w) for w in NUMBER_WORDS)), t)
    return (
        F.when(t.isNull(), F.lit(None).cast(_DECIMAL))
        .when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits.cast(_DECIMAL))
        .when(t.isin("no", "none"), F.lit(0).cast(_DECIMAL))
        .when(place > 0, (place - 1).cast(_DECIMAL))
        .otherwise(_refused("no number word", text))
    )


def ix_number(text: Column, code: Column) -> Column:
    """The unscaled, unsigned number that an inline fact shows, by its format code; null text gives null; a code that is
    unknown, or a text that its code does not admit, raises."""
    t, local = F.regexp_replace(text, r"^\s+|\s+$", ""), _local(code)
    return (
        F.when(text.isNull(), F.lit(None).cast(_DECIMAL))
        .when(code.isNull() & t.rlike(r"^(\d+\.?\d*|\.\d+)$"), t.cast(_DECIMAL))
        .when((local == "num-dot-decimal") & t.rlike(DOT_DECIMAL), F.regexp_replace(t, "[,  ]", "").cast(_DECIMAL))
        .when(local == "fixed-zero", F.lit(0).cast(_DECIMAL))
        .when(local == "numwordsen", spoken_number(t))
        .otherwise(_refused("number format", F.concat_ws(" ", code, t)))
    )


def _plain(number: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def words_duration(text: Column) -> Column:
    """`one year and six months` as P1Y6M: number words to twenty, tens with a unit, or digits; hyphens are spaces; what is not covered raises."""
    t = F.regexp_replace(F.lower(text), "-", " ")
    pattern = r"(?:\b([a-z]+)\s+)?\b([a-z]+|\d+(?:\.\d+)?)\s+(year|month|day)s?\b"
    groups = [F.regexp_extract_all(t, F.lit(pattern), g) for g in (1, 2, 3)]
    tens, ones = F.array(*(F.lit(w) for w in TENS_WORDS)), F.array(*(F.lit(w) for w in NUMBER_WORDS))

    def amount(before: Column, number: Column) -> Column:
        ten, one = F.array_position(tens, before), F.array_position(ones, before)
        unit = F.when(number.rlike(r"^[1-9]$"), number.cast(_DECIMAL)).otherwise(F.array_position(F.slice(ones, 2, 9), number).cast(_DECIMAL))
        whole = (
            F.when(F.contains(number, F.lit(".")), _refused("a fraction in words", text))
            .when((ten > 0) & (unit > 0), ((ten + 1) * 10 + unit).cast(_DECIMAL))
            .when((ten > 0) | (one > 0), _refused("a number in words", text))
            .when(F.array_position(tens, number) > 1, _refused("a number in words", text))
            .otherwise(spoken_number(number))
        )
        return whole

    zipped = F.arrays_zip(groups[0].alias("b"), groups[1].alias("n"), groups[2].alias("u"))
    found = F.transform(zipped, lambda x: F.struct(_plain(amount(x["b"], x["n"])).alias("v"), x["u"].alias("u")))
    last = lambda unit, letter: F.coalesce(F.concat(F.try_element_at(F.transform(F.filter(found, lambda x: x["u"] == unit), lambda x: x["v"]), F.lit(-1)), F.lit(letter)), F.lit(""))
    spoken = F.concat(last("year", "Y"), last("month", "M"), last("day", "D"))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(spoken == "", _refused("no duration in words", text, "string")).otherwise(F.concat(F.lit("P"), spoken))


def ix_text(text: Column, code: Column) -> Column:
    """The canonical text of an inline fact by its format code: dates, durations, flags, or the text; an unknown code raises."""
    t, local = F.regexp_replace(text, r"^\s+|\s+$", ""), _local(code)
    spaced = F.regexp_replace(F.regexp_replace(t, " ", " "), r"\s+", " ")
    date = lambda c, shown, wanted: F.date_format(F.to_date(c, shown), wanted)
    return (
        F.when(text.isNull() | code.isNull(), t)
        .when(local == "fixed-true", "true")
        .when(local == "fixed-false", "false")
        .when((local == "boolballotbox") & (t == "☒"), "true")
        .when((local == "boolballotbox") & (t == "☐"), "false")
        .when(local == "date-monthname-day-year-en", date(spaced, "MMMM d, yyyy", "yyyy-MM-dd"))
        .when(local == "date-year-month-day", date(spaced, "yyyy-MM-dd", "yyyy-MM-dd"))
        .when(local == "date-monthname-year-en", date(F.concat(F.lit("1 "), spaced), "d MMMM yyyy", "yyyy-MM"))
        .when(local == "date-monthname-day-en", F.concat(F.lit("--"), date(F.concat(spaced, F.lit(" 2000")), "MMMM d yyyy", "MM-dd")))
        .when(local == "duryear", years_duration(spoken_number(t)))
        .when(local == "durmonth", F.concat(F.lit("P"), _plain(spoken_number(t)), F.lit("M")))
        .when(local == "durday", F.concat(F.lit("P"), _plain(spoken_number(t)), F.lit("D")))
        .when(local == "durwordsen", words_duration(t))
        .when(local.isin("exchnameen", "stateprovnameen", "entityfilercategoryen"), t)
        .otherwise(_refused("text format", F.concat_ws(" ", code, t), "string"))
    )


def scaled(number: Column, scale: Column, negated: Column) -> Column:
    """number x 10^scale with its sign, exact."""
    powers = F.create_map(*(x for k in range(-6, 13) for x in (F.lit(k), F.lit(f"1e{k}").cast("decimal(19,6)"))))
    return (number.cast("decimal(19,6)") * powers[F.coalesce(scale, F.lit(0))] * F.when(negated, -1).otherwise(1)).cast("decimal(38,6)")


def indent_points(style: Column) -> Column:
    """Points that a style indents by: in 72, px 0.75, em 10, pt 1, % 5."""
    found = F.regexp_extract_all(style, F.lit(r"(?:padding-left|margin-left|text-indent)\s*:\s*(-?[0-9.]+(?:pt|px|in|em|%))"), 1)
    unit = F.create_map(*(F.lit(x) for x in ("pt", 1.0, "px", 0.75, "in", 72.0, "em", 10.0, "%", 5.0)))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + F.regexp_extract(x, r"-?[0-9.]+", 0).cast("double") * unit[F.regexp_extract(x, "(pt|px|in|em|%)$", 1)])
