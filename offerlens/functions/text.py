"""Text folding, lenient parsing and text cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The two non-ASCII digit systems, interchangeable letter forms.
FOREIGN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "01234567890123456789"
LETTER_FORMS = "يكةأإآ"
LETTER_FOLDED = "یکهااا"
HALF_SPACE = "‌"
ZERO_WORD = "صفر"
PHONE_TAG = "[شماره تماس حذف شد]"

_DIGIT = "[0-9۰-۹٠-٩]"
PHONE = (
    f"(?<!{_DIGIT})(?:\\+?[9۹٩][8۸٨]|[0۰٠])[\\s.\\-]?{_DIGIT}(?:[\\s.\\-]?{_DIGIT}){{8,10}}(?!{_DIGIT})"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a costly expression several times while evaluating it once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and columns read but never repeat.

    A filter on a plain column is pushed below it with a copy of its expression;
    nothing is pushed below a generator, so the value is computed once per row. It is
    computed by the projection below: a generator alone would interpret its expression.
    """
    made = f"_once_{name}"
    return df.withColumn(made, value).withColumn(name, F.explode(F.array(made))).drop(made)


def filled(c: Column) -> Column:
    """A text, or NULL for an empty one. ``nullif`` inside a branch computes its text twice."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def fold_digits(c: Column) -> Column:
    return F.translate(c, FOREIGN_DIGITS, ASCII_DIGITS)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no builtin for it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


# Characters that the compatibility normal form leaves alone, in any neighbourhood: ASCII and
# the letters and digits of the Arabic block. Marks that can join a letter are not among them.
STABLE = r"\x00-\x7F\u060C\u061B\u061F\u0621-\u064A\u0660-\u066D\u0671-\u0674\u0679-\u06D3\u06F0-\u06FF\u200C"


def compatible(c: Column) -> Column:
    """The compatibility normal form. Only texts with a character outside ``STABLE`` cross to
    Python; the others go there as nulls."""
    return F.coalesce(nfkc(F.when(c.rlike(f"[^{STABLE}]"), c)), c)


def fold_text(c: Column, compatibility: bool = False) -> Column:
    """Lossy form for matching: one digit system, one letter form, single blanks.

    ``compatibility`` adds the NFKC step for texts that carry presentation forms or
    full-width characters: feeds do, typed queries do not.
    """
    source = compatible(c) if compatibility else c
    mapped = F.translate(
        F.coalesce(source, F.lit("")), FOREIGN_DIGITS + LETTER_FORMS + HALF_SPACE, ASCII_DIGITS + LETTER_FOLDED + " "
    )
    return F.lower(F.trim(F.regexp_replace(mapped, r"(?U)[،,/\\|_\-–—\s]+", " ")))


def join_fields(*columns: Column) -> Column:
    """Non-empty fields in order of trust, one blank between them."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def lenient_int(c: Column) -> Column:
    """Digits of a text as a number ("1,250 km" gives 1250), NULL without digits."""
    digits = F.regexp_replace(fold_digits(c.cast("string")), "[^0-9]", "")
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def mileage(c: Column, is_number: Column | None = None) -> Column:
    """A reading; the word for zero anywhere in the text means 0."""
    return F.when(c.contains(ZERO_WORD), F.lit(0).cast("bigint")).otherwise(lenient_int(c))


def split_year(year: Column, offset: int = 621) -> tuple[Column, Column]:
    """A year of either calendar as (solar Hijri, Gregorian); NULLs when neither."""
    hijri, gregorian = year.between(1300, 1500), year.between(1900, 2100)
    return (
        F.when(hijri, year).when(gregorian, year - offset).cast("int"),
        F.when(hijri, year + offset).when(gregorian, year).cast("int"),
    )


def canonical_price(amount: Column, divisor: Column, floor: int = 10_000_000) -> Column:
    """An amount in the canonical unit, NULL when it is a placeholder.

    The divisor is a fact about the source; it is never guessed from the amount.
    """
    price = F.floor(amount / divisor).cast("bigint")
    return F.when((amount > 0) & (price >= floor), price)


def keyword_label(c: Column, table: dict[str, str]) -> Column:
    """Label of a text: an exact key first, else the longest key it contains."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def found(raw: Column, low: Column) -> Column:
        chain = None
        for key in sorted(table, key=len, reverse=True):
            hit = low.contains(key) | raw.contains(key)
            chain = F.when(hit, F.lit(table[key])) if chain is None else chain.when(hit, F.lit(table[key]))
        return F.when(F.length(raw) > 0, F.coalesce(F.try_element_at(entries, low), F.try_element_at(entries, raw), chain))

    return let(F.trim(c), lambda raw: let(F.lower(raw), lambda low: found(raw, low)))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether a text holds one of the phrases, half-spaces read as blanks."""
    flat = F.translate(F.coalesce(c, F.lit("")), HALF_SPACE, " ")
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | flat.contains(phrase.replace(HALF_SPACE, " "))
    return hit


def redact_phones(c: Column, tag: str = PHONE_TAG) -> Column:
    """Cut phone-like runs, in whichever digits they are written."""
    return F.regexp_replace(c, PHONE, tag)


def clean_prose(c: Column) -> Column:
    """Seller text with its lines kept: blanks collapse, placeholders become NULL."""
    single = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    trimmed = F.regexp_replace(single, r"(?m)^ +| +$", "")
    text = F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    worth = lambda t: (F.length(t) >= 2) & t.rlike(r"(?U)[\w؀-ۿ]")
    return let(text, lambda t: F.when(worth(t), redact_phones(t)))


def strip_prefix(c: Column, pattern: str) -> Column:
    """Remove an anchored boilerplate sentence."""
    return F.regexp_replace(c, pattern, "")


def defuse_formula(c: Column) -> Column:
    """Quote a cell that a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def clamp_label(c: Column, default: str = "landing", longest: int = 40) -> Column:
    """A trimmed label, or the default when it is empty, long or unprintable."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bad = t.isNull() | (F.length(t) == 0) | (F.length(t) > longest) | t.rlike("[\\p{C}\\p{Zl}\\p{Zp}&&[^‌]]") | t.rlike("[\\p{Zs}&&[^ ]]")
    return F.when(bad, F.lit(default)).otherwise(t)


def ip_prefix(c: Column) -> Column:
    """An IPv4 address cut to its /24; an empty text for anything else."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(
        c.rlike(f"^{octet}(?:\\.{octet}){{3}}$"), F.concat(F.regexp_extract(c, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24"))
    ).otherwise(F.lit(""))
