"""Column functions over text: numbers, flags, ranges, scanner repairs, names, dosages, stages, sections.

All are built-in expressions (Java regular expressions), so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[<>]?\s*([\d.]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it (an expression of columns would be repeated each time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def parse_numeric(raw: Column) -> Column:
    """The number a value cell begins with, else what its digits, points and signs make (up to ten of them); units give null."""
    s = F.trim(raw)
    unit_like = s.rlike(r"(?i)^x?10E\d") | s.rlike(r"^[a-zA-Z]+/[a-zA-Z]+") | s.rlike(r"^/[a-zA-Z]+") | s.rlike(r"(?i)^\d*E\d+/")
    lead = try_double(first_group(s, NUMBER))
    rest = F.regexp_replace(s, r"[^\d.\-+]", "")
    rest = F.when(s.rlike(r"(?i)E\d+/") | (F.length(rest) > 10), F.lit(None).cast("double")).otherwise(try_double(rest))
    return F.when(unit_like | (s == ""), F.lit(None).cast("double")).otherwise(F.coalesce(lead, rest))


#: Flag patterns in the order they are tried, and what they mean; fixed values.
FLAGS = [(r"\b(High)\b", "H"), (r"\b(Low)\b", "L"), (r"\bHH\b", "HH"), (r"\bLL\b", "LL"), (r"\bH\b", "H"), (r"\bL\b", "L"), (r"\bCRITICAL\b", "CRITICAL"), (r"\*+$", "*")]


def value_flag(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, flag in reversed(FLAGS):
        out = F.when(F.trim(raw).rlike("(?i)" + pattern), flag).otherwise(out)
    return out


def without_flag(raw: Column) -> Column:
    s = F.trim(raw)
    out = s
    for pattern, _ in reversed(FLAGS):
        out = F.when(s.rlike("(?i)" + pattern), F.trim(F.regexp_replace(s, "(?i)" + pattern, ""))).otherwise(out)
    return out


def flagged_value(raw: Column) -> Column:
    return let(without_flag(raw), parse_numeric)


def value_unit(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), r"^[<>]?\s*[\d.]+\s*", "")
    s = F.trim(F.regexp_replace(s, r"(?i)\b(High|Low|HH|LL|H|L|CRITICAL)\b", ""))
    return F.when(s.rlike(r"^\d+$"), "").otherwise(s)


def parse_range(raw: Column) -> Column:
    """struct(low, high) of '4.5-11', '>60' (to infinity) or '<5' (from 0); null for words."""
    s = F.trim(raw)
    words = s.rlike(r"(?i)^(negative|positive|non[\-\s]?reactive|reactive|normal|abnormal|n/a)$") | s.rlike(r"(?i)^see\s+")
    both, over, under = r"(\d+\.?\d*)\s*[-–—]\s*(\d+\.?\d*)", r"^[>≥]\s*=?\s*(\d+\.?\d*)", r"^[<≤]\s*=?\s*(\d+\.?\d*)"
    pair = lambda lo, hi: F.struct(lo.alias("low"), hi.alias("high"))
    none = F.lit(None).cast("struct<low:double,high:double>")
    return (
        F.when(words | (s == ""), none)
        .when(s.rlike(both), pair(try_double(F.regexp_extract(s, both, 1)), try_double(F.regexp_extract(s, both, 2))))
        .when(s.rlike(over), pair(try_double(F.regexp_extract(s, over, 1)), F.lit(float("inf"))))
        .when(s.rlike(under), pair(F.lit(0.0), try_double(F.regexp_extract(s, under, 1))))
    )


def is_numeric(raw: Column) -> Column:
    return F.coalesce(try_double(F.regexp_replace(F.trim(raw), "[<>≤≥]", "")).isNotNull(), F.lit(False))


def normalise_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[/:,\-\(\)]", " "), r"\s+", " "))


def _repair_number(t: Column) -> Column:
    c = F.when(t.rlike(r"(?i)10E\d+/"), t).otherwise(F.regexp_replace(F.regexp_replace(t, r"(\d)[Ee](\d)", "$1$2"), r"(\d)[Ee](\.)", "$1$2"))
    c = _join_digit(_join_digit(c, r"(\d)[Oo](\d)", "0"), r"(\d)[lI](\d)", "1")
    c = F.regexp_replace(F.regexp_replace(c, r"^[lI](\d)", "1$1"), r"^S(\d)", "5$1")
    c = _join_digit(c, r"(\d)B(\d)", "8")

    def kept(c: Column) -> Column:
        lead = first_group(c, NUMBER)
        return F.when(~t.rlike(r"\d"), t).when((c != t) & lead.isNotNull() & try_double(lead).isNull(), t).otherwise(c)

    return let(c, kept)


def _join_digit(c: Column, pattern: str, digit: str) -> Column:
    """Put a digit between two groups; '$1' and a digit would read as one group number."""
    return F.replace(F.regexp_replace(c, pattern, "$1\u0001$2"), F.lit("\u0001"), F.lit(digit))


def repair_value(raw: Column) -> Column:
    """Scanner errors in a number or range: O for 0, l or I for 1, S for 5, B for 8, stray E; kept only if a number results."""

    def repaired(s: Column) -> Column:
        at = F.regexp_instr(s, F.lit(r"[-–]"))
        left, dash, right = F.trim(F.substring(s, F.lit(1), at - 1)), F.substring(s, at, F.lit(1)), F.trim(F.substring(s, at + 1, F.length(s)))
        both = F.concat(let(left, _repair_number), dash, let(right, _repair_number))
        return F.when(~s.rlike(r"\d"), s).when(s.rlike(r"\d\s*[-–]\s*\d"), both).otherwise(_repair_number(s))

    return let(F.trim(raw), repaired)


# Marks at the end of a label, taken off one after the other.
FOOTNOTES = [r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+$", r"\s*[\(\[]\d+[\)\]]$", r"\s*\*+$", r"\s*†+$", r"\s*‡+$", r"_\d{1,2}$", r"(?<=[a-zA-Z])\d{1,2}$", r"\s*\d{1,2}$"]


def strip_footnotes(text: Column) -> Column:
    """A label without the marks at its end: superscripts, bracketed numbers, stars, daggers, one or two digits."""
    c = F.trim(text)
    for pattern in FOOTNOTES:
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def join_split_words(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z]{3,}) ([a-z]{1,3})\b", "$1$2")


def sound_code(word: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y all part equal codes; other signs count as vowels."""
    codes = F.translate(F.upper(word), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    rest = F.regexp_replace(F.regexp_replace(codes, r"[^0-9]", "0"), r"(.)\1+", "$1")
    digits = F.regexp_replace(F.substring(rest, 2, 1000), "0", "")
    return F.rpad(F.concat(F.upper(F.substring(word, 1, 1)), digits), 4, "0")


def scanner_variants(word: Column) -> Column:
    """Words a scanner may have read for this one: one confusion each, sorted (fixed confusions)."""
    swaps = [("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("5", "s"), ("s", "5"), ("8", "b"), ("b", "8"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv")]
    made = F.array(*[F.replace(word, F.lit(a), F.lit(b)) for a, b in swaps])
    return F.array_sort(F.array_distinct(F.filter(made, lambda x: x != word)))


def dosage(text: Column) -> Column:
    """struct(value, unit) of the first strength, else of a percentage."""
    amount, percent = r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?)\b", r"(\d+(?:\.\d+)?)\s*%"
    return F.when(text.rlike(amount), F.struct(F.regexp_extract(text, amount, 1).cast("double").alias("value"), F.lower(F.regexp_extract(text, amount, 2)).alias("unit"))).when(
        text.rlike(percent), F.struct(F.regexp_extract(text, percent, 1).cast("double").alias("value"), F.lit("%").alias("unit"))
    )


# Words for routes in the order they are tried, and their names.
ROUTES = [
    ("oral", "oral"), ("po", "oral"), ("by mouth", "oral"), ("iv", "intravenous"), ("intravenous", "intravenous"), ("im", "intramuscular"), ("intramuscular", "intramuscular"),
    ("sc", "subcutaneous"), ("subcutaneous", "subcutaneous"), ("topical", "topical"), ("transdermal", "transdermal"), ("inhaled", "inhaled"), ("inhalation", "inhalation"),
    ("sublingual", "sublingual"), ("sl", "sublingual"), ("rectal", "rectal"), ("pr", "rectal"), ("ophthalmic", "ophthalmic"), ("otic", "otic"), ("intranasal", "intranasal"),
]
# Abbreviations of frequencies in the order they are tried, and the forms with a number after them.
FREQUENCIES = [
    ("qd", "once daily"), ("bid", "twice daily"), ("tid", "three times daily"), ("qid", "four times daily"), ("q4h", "every 4 hours"), ("q6h", "every 6 hours"), ("q8h", "every 8 hours"),
    ("q12h", "every 12 hours"), ("qhs", "at bedtime"), ("prn", "as needed"), ("ac", "before meals"), ("pc", "after meals"),
]
NUMBERED = [(r"(\d+)\s*times?\s*(?:per|a|daily)", "times_per_day"), (r"every\s*(\d+)\s*hours?", "every_n_hours"), (r"(\d+)\s*times?\s*(?:per|a)\s*week", "times_per_week")]


def frequency(text: Column) -> Column:
    """struct(code, description) of the first abbreviation (substrings count), else (kind, every) of the first form with a number."""
    low = F.lower(text)
    code, kind, every = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for word, _ in reversed(FREQUENCIES):
        code = F.when(low.contains(word), word).otherwise(code)
    for pattern, name in reversed(NUMBERED):
        kind, every = F.when(low.rlike(pattern), name).otherwise(kind), F.when(low.rlike(pattern), F.regexp_extract(low, pattern, 1).try_cast("int")).otherwise(every)
    none = code.isNull()
    return F.struct(code.alias("code"), first_contained(text, FREQUENCIES, None).alias("description"), F.when(none, kind).alias("kind"), F.when(none, every).alias("every"))


def first_contained(text: Column, pairs: list[tuple[str, str]], default: str | None) -> Column:
    """What the first contained word stands for (substrings count)."""
    low, out = F.lower(text), F.lit(default).cast("string")
    for word, means in reversed(pairs):
        out = F.when(low.contains(word), means).otherwise(out)
    return out


def quantity(text: Column) -> Column:
    return F.coalesce(first_group(text, r"(?i)(?:qty|quantity|disp|dispense)[:\s]*(\d+)"), first_group(text, r"#(\d+)")).try_cast("int")


def refills(text: Column) -> Column:
    return F.coalesce(first_group(text, r"(?i)(?:refills?|ref)[:\s]*(\d+)"), first_group(text, r"(?i)(\d+)\s*refills?")).try_cast("int")


def stage(text: Column) -> Column:
    """struct(t, n, m): the three together if they stand together, else the first of each anywhere."""
    joint = r"(?i)(T[0-4][a-c]?)\s*(N[0-3][a-c]?)\s*(M[0-1][a-c]?)"
    one = lambda p: F.upper(first_group(text, "(?i)(" + p + ")"))
    part = lambda k, p: F.when(text.rlike(joint), F.upper(F.regexp_extract(text, joint, k))).otherwise(one(p))
    return F.struct(part(1, "T[0-4][a-c]?").alias("t"), part(2, "N[0-3][a-c]?").alias("n"), part(3, "M[0-1][a-c]?").alias("m"))


def measurements(text: Column) -> Column:
    """All sizes in cm: three-, then two-, then one-dimensional; a smaller pattern counts inside a larger one again."""
    n = r"\d+\.?\d*"
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (rf"(?i){n}\s*x\s*{n}\s*x\s*{n}\s*cm", rf"(?i){n}\s*x\s*{n}\s*cm", rf"(?i){n}\s*cm")])


def field_key(label: Column) -> Column:
    key = F.regexp_replace(F.replace(F.replace(F.lower(label), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")), "[^a-z0-9_]", "")
    return F.trim(F.lit("_"), F.regexp_replace(key, "_+", "_"))


def universal_patterns(text: Column) -> Column:
    """struct(dates (the first three, distinct), email, phone)."""
    dates = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))), 1, 3)
    return F.struct(dates.alias("dates"), first_group(text, r"([\w.-]+@[\w.-]+\.\w+)").alias("email"), first_group(text, r"\b(\d{3}[\s.-]?\d{3}[\s.-]?\d{4})\b").alias("phone"))


# Date layouts in the order they are tried; month before day.
DATE_LAYOUTS = ["M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyyMMdd"]


def iso_date(raw: Column) -> Column:
    """A date as yyyy-MM-dd: what begins like one already is cut to it, else the first layout that reads it; else null."""
    s = F.trim(raw)
    parsed = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in DATE_LAYOUTS])
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).otherwise(F.date_format(parsed, "yyyy-MM-dd"))


# Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def date_of_parts(first: Column, second: Column, third: Column) -> Column:
    """The date of month, day and year, or of year (four signs), month and day; months may be words, years of two digits are near 2000."""
    low = F.lower(first)
    word = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS):
        word = F.when(low.isin(name, name[:3]), i + 1).otherwise(word)
    a, b, c = (x.try_cast("int") for x in (first, second, third))
    led_by_year = word.isNull() & (F.length(first) == 4)
    year = full_year(F.when(led_by_year, a).otherwise(c))
    month, day = F.when(led_by_year, b).otherwise(F.coalesce(word, a)), F.when(led_by_year, c).otherwise(b)
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def value_after(text: Column, field: Column) -> Column:
    """struct(value, unit): the number that follows a field's name in a text ("_" stands for blanks, "_" or "-"), and the word after it.

    Each row has a name of its own; signs in it stand for themselves.
    """
    plain = F.regexp_replace(field, r"([^\p{L}\p{N}_\s])", r"\\$1")
    pattern = F.concat(F.lit("(?i)"), F.replace(plain, F.lit("_"), F.lit(r"[\s_-]*")), F.lit(r"\s*[:\s]\s*([\d.,]+)\s*(\w+)?"))
    number = parse_numeric(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    unit = F.call_function("regexp_extract", text, pattern, F.lit(2))
    return F.when(number.isNotNull(), F.struct(number.alias("value"), unit.alias("unit")))


def full_year(two_digits: Column) -> Column:
    return F.when(two_digits >= 100, two_digits).when(two_digits < 50, two_digits + 2000).otherwise(two_digits + 1900)


def age(born: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def timeout_seconds(pages: Column, base: int = 600, page: int = 60, free: int = 3) -> Column:
    return base + F.greatest(pages - free, F.lit(0)) * page


def json_block(response: Column) -> Column:
    """What stands between the first and the last brace."""
    return first_group(response, r"(?s)(\{.*\})")


def leading_range(raw: Column) -> tuple[Column, Column]:
    """Bounds that a cell begins with: "1-2", "< 2" (from 0) or "> 1" (no end); only the plain hyphen counts."""
    number = r"(\d+\.?\d*)"
    between, under, over = rf"^{number}\s*-\s*{number}", rf"^<\s*{number}", rf"^>\s*{number}"
    low = F.when(raw.rlike(between), try_double(F.regexp_extract(raw, between, 1))).when(raw.rlike(under), 0.0).otherwise(try_double(first_group(raw, over)))
    high = F.when(raw.rlike(between), try_double(F.regexp_extract(raw, between, 2))).when(raw.rlike(under), try_double(F.regexp_extract(raw, under, 1))).when(raw.rlike(over), float("inf"))
    return low, high


def range_texts(raw: Column) -> tuple[Column, Column]:
    """The two numbers that a cell begins with, as they are written; hyphen or en dash between."""
    pattern = r"^(\d+\.?\d*)\s*[-–]\s*(\d+\.?\d*)"
    return first_group(raw, pattern, 1), first_group(raw, pattern, 2)
