"""Display text and value checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pesos(amount: Column) -> Column:
    """'$ 1.234.567': no decimals, dots between thousands, a no-break space after the sign."""
    whole = F.round(amount, 0)
    digits = F.translate(F.format_number(F.abs(whole), 0), ",", ".")
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.lit("$\u00a0"), digits)


def capitalise_words(text: Column) -> Column:
    """Lower case with each blank-separated word's first letter raised; '' for NULL."""
    words = F.transform(
        F.split(F.lower(text), " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
    )
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def capitalise_first(text: Column) -> Column:
    rest = F.lower(F.substring(text, F.lit(2), F.length(text)))
    return F.coalesce(F.concat(F.upper(F.substring(text, 1, 1)), rest), F.lit(""))


def confidence_label(confidence: Column) -> Column:
    """'96%' for 95.7, 'N/A' for NULL; halves round up."""
    whole = F.floor(confidence + F.lit(0.5)).cast("bigint").cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit("N/A"))


def slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))


def localised(translations: Column, locale: str, name: Column) -> Column:
    return F.coalesce(F.try_element_at(translations, F.lit(locale)), name)


def is_valid_date(text: Column) -> Column:
    """YYYY-MM-DD with month 1-12 and day 1-31; a day past its month's end still counts."""
    part = r"^(\d{4})-(\d{2})-(\d{2})$"
    month = F.regexp_extract(text, part, 2).try_cast("int")
    day = F.regexp_extract(text, part, 3).try_cast("int")
    ok = text.rlike(part) & month.between(1, 12) & day.between(1, 31)
    return F.coalesce(ok, F.lit(False))


def is_valid_time(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^([01]\d|2[0-3]):([0-5]\d)$"), F.lit(False))


def is_valid_amount(amount: Column) -> Column:
    number = amount.cast("double")
    ok = (number > 0) & ~F.isnan(number) & (number != F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))


def is_valid_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))
