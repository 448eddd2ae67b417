"""Message text to expense fields, as column expressions.

The deterministic parse rules for bank, wallet and hand-typed messages. Every function
takes and returns columns, so a whole parse is one projection that stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell.fixed_values import (
    END,
    MERCHANT_WORDS,
    MONTH_WORDS,
    PLAIN_WORDS,
    DONE_WITH_AMOUNT,
    REMINDER,
    SKIP_PATTERNS,
    SKIP_PHRASES,
    SUMMARY,
    WEEKDAY_WORDS,
)
from tallywell.functions.eventtime import arrival_date
from tallywell.functions.text import contains_any, grab, group1, has_any, pad2, told

MONEY = "decimal(15,2)"

# -- amounts -----------------------------------------------------------------------------
SIGNED_AMOUNT = r"(?i)\$\s*(\d[\d.,]*)\s*(k|mil)?" + END
SUFFIXED_AMOUNT = r"(?i)(?:^|[^0-9A-Za-z_.,*])(\d[\d.,]*)\s*(k|mil)" + END
NOT_AN_AMOUNT = (
    r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\*\d+|\d{10,}"
    r"|\d{1,2}\s*(?:am|pm)|\d{1,2} de [a-z]+|el \d{1,2}(?:[^0-9.,]|$)"
)
BARE_AMOUNT = r"(\d[\d.,]*)"
CENTS = r"[.,](\d{2})[.,]?$"


def _whole_number(digits: Column) -> Column:
    """'119.000,00' -> 119000.00: two digits after the last separator are cents."""
    cents = F.coalesce(group1(digits, CENTS), F.lit("00"))
    whole = F.replace(F.replace(F.regexp_replace(digits, CENTS, ""), F.lit(".")), F.lit(","))
    return F.concat(whole, F.lit("."), cents).try_cast(MONEY)


def _thousands(digits: Column) -> Column:
    """Digits before 'k' or 'mil': '20' -> 20000, '1.5' -> 1500, '1.200' -> 1200000."""
    decimal = F.regexp_replace(digits, ",", ".").try_cast(MONEY)
    plain = F.regexp_replace(digits, "[.,]", "").try_cast(MONEY)
    number = F.when(digits.rlike(r"^\d+[.,]\d{1,2}$"), decimal).otherwise(plain)
    return (number * F.lit(1000)).try_cast(MONEY)


def amount() -> Column:
    """Money from the columns of ``amount_digits``."""
    digits = told("_digits")
    return F.when(F.col("_in_thousands"), _thousands(digits)).otherwise(_whole_number(digits))


def amount_captures(text: Column, folded: Column) -> dict[str, Column]:
    """What each form of an amount captures; a form is looked for only where its tell-tale characters occur."""
    signed = has_any(text, ["$"])
    suffix = has_any(folded, ["k", "mil"])
    return {
        "_signed": F.when(signed, grab(text, SIGNED_AMOUNT)),
        "_signed_suffix": F.when(signed & suffix, grab(text, SIGNED_AMOUNT, 2)),
        "_suffixed": F.when(~signed & suffix, grab(text, SUFFIXED_AMOUNT)),
    }


def amount_digits(folded: Column) -> dict[str, Column]:
    """The digits that count, from ``amount_captures``: a '$' number, then '20k' or '50mil', then a bare number."""
    signed, suffixed = told("_signed"), told("_suffixed")
    bare = grab(F.regexp_replace(folded, NOT_AN_AMOUNT, " "), BARE_AMOUNT)
    return {
        "_digits": F.when(signed.isNotNull(), signed).when(suffixed.isNotNull(), suffixed).otherwise(bare),
        "_in_thousands": told("_signed_suffix").isNotNull() | (signed.isNull() & suffixed.isNotNull()),
    }


# -- source, bank, payment ---------------------------------------------------------------
DEBIT_WORDS = ["t.deb", "t. deb", "debito"]
CREDIT_WORDS = ["credito", "t.cred", "t. cred"]
SAVINGS_WORDS = ["ahorros", "transferiste", "enviaste", "transferencia", "transfer to", "sent to"]


def source(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit("Bancolombia:")), "bancolombia_email")
        .when(F.contains(text, F.lit("Nequi:")) | F.contains(text, F.lit("85954")), "nequi_sms")
        .otherwise("manual")
    )


def bank(folded: Column, source_col: Column) -> Column:
    return (
        F.when(source_col == "bancolombia_email", "bancolombia")
        .when(source_col == "nequi_sms", "nequi")
        .when(F.contains(folded, F.lit("bancolombia")), "bancolombia")
        .when(F.contains(folded, F.lit("nequi")), "nequi")
        .when(F.contains(folded, F.lit("daviplata")), "daviplata")
        .otherwise("cash")
    )


def payment_type(folded: Column, source_col: Column) -> Column:
    return (
        F.when(has_any(folded, DEBIT_WORDS), "debit")
        .when(has_any(folded, CREDIT_WORDS), "credit")
        .when(source_col == "nequi_sms", "transfer")
        .when(source_col == "bancolombia_email", "debit")
        .otherwise("cash")
    )


def account_type(folded: Column) -> Column:
    return (
        F.when(has_any(folded, ["credito de libre inversion", "prestamo"]), "credit")
        .when(has_any(folded, DEBIT_WORDS), "checking")
        .when(has_any(folded, CREDIT_WORDS), "credit_card")
        .when(has_any(folded, SAVINGS_WORDS), "savings")
    )


def last_four(text: Column) -> Column:
    return F.coalesce(
        F.when(has_any(text, ["*"]), group1(text, r"\*(\d{4})" + END)),
        group1(text, r"(?i)(?:bancolombia|nequi|daviplata)\s+(\d{4})" + END),
    )


# -- category ----------------------------------------------------------------------------
def _word_table(words: dict[str, list[str]]) -> dict[str, str]:
    return {word: slug for slug, group in words.items() for word in group}


#: Names that are also written without their sign.
UNSIGNED = {w[:-1]: slug for w, slug in _word_table(MERCHANT_WORDS).items() if not w[-1].isalnum()}
WORD_TO_SLUG = _word_table(MERCHANT_WORDS) | UNSIGNED | _word_table(PLAIN_WORDS)


def _alternation(words) -> str:
    """Words as wholes, the longest first; one that ends in a sign ends there."""
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    signed = [re.escape(w) for w in longest_first if not w[-1].isalnum()]
    plain = "(?:" + "|".join(w for w in longest_first if w[-1].isalnum()) + r")\b"
    return r"\b(" + "|".join([*signed, plain]) + ")"


ANY_WORD = _alternation(WORD_TO_SLUG)
ANY_MERCHANT = _alternation(_word_table(MERCHANT_WORDS) | UNSIGNED)


def _by_first_letter(words) -> str:
    """Finds what ``_alternation`` finds, but tries only the words that begin as the text does."""
    letters: dict[str, list[str]] = {}
    for word in sorted(words, key=lambda w: (-len(w), w)):
        letters.setdefault(word[0], []).append(word)
    groups = []
    for letter, group in letters.items():
        signed = [re.escape(w[1:]) for w in group if not w[-1].isalnum()]
        plain = [w[1:] for w in group if w[-1].isalnum()]
        groups.append(letter + "(?:" + "|".join([*signed, *([r"(?:" + "|".join(plain) + r")\b"] if plain else [])]) + ")")
    return r"\b(" + "|".join(groups) + ")"


FIND_WORD = _by_first_letter(WORD_TO_SLUG)
FIND_MERCHANT = _by_first_letter(_word_table(MERCHANT_WORDS) | UNSIGNED)


def category(folded_description: Column) -> Column:
    """Slug of the longest known word in the text ('uber eats' beats 'uber'), else 'missing'.

    One regular-expression pass collects the words; a literal map turns the longest one
    (ties: the alphabetically last) into its slug.
    """
    words = F.regexp_extract_all(folded_description, F.lit(FIND_WORD), F.lit(1))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w), w.alias("word"))))
    slugs = F.create_map(*[F.lit(x) for pair in WORD_TO_SLUG.items() for x in pair])
    return F.coalesce(F.try_element_at(slugs, longest["word"]), F.lit("missing"))


# -- dates and times ---------------------------------------------------------------------
MONTHS = "|".join(MONTH_WORDS)
WEEKDAYS = "|".join(WEEKDAY_WORDS)
NAMED_DAY = rf"(\d{{1,2}}) de ({MONTHS})(?: del? (\d{{4}}))?"
NAMED_WEEKDAY = rf"\bel ({WEEKDAYS})\b"
DAY_OF_MONTH = r"\bel (\d{1,2})(?:[^0-9/:.,]|$)"


def date_captures(folded: Column) -> dict[str, Column]:
    """Each form is looked for only where its tell-tale characters occur."""
    named, spoken = F.contains(folded, F.lit(" de ")) & has_any(folded, MONTH_WORDS), has_any(folded, ["el "])
    return {
        "_slashed": F.when(has_any(folded, ["/"]), grab(folded, r"(\d{1,2}/\d{1,2}/\d{4})")),
        "_dashed": F.when(has_any(folded, ["-"]), grab(folded, r"(\d{4}-\d{2}-\d{2})")),
        "_named": F.when(named, grab(folded, NAMED_DAY, 0)),
        "_spoken_weekday": F.when(spoken, grab(folded, NAMED_WEEKDAY)),
        "_spoken_day": F.when(spoken, grab(folded, DAY_OF_MONTH)),
        "_last_monday": has_any(folded, ["last monday"]),
        "_this_period": has_any(folded, ["esta semana", "this week", "este mes", "this month"]),
        "_days_ago": days_ago(folded),
    }


def date_parts(received_at: Column) -> dict[str, Column]:
    """The parts of the stated date, from ``date_captures``; the arrival date only where the stated one needs it."""
    named, weekday, month_day = told("_named"), told("_spoken_weekday"), told("_spoken_day")
    needs_today = (
        named.isNotNull() | weekday.isNotNull() | month_day.isNotNull() | F.col("_days_ago").isNotNull()
        | F.col("_last_monday") | F.col("_this_period")
    )
    return {
        "_explicit": F.coalesce(told("_slashed"), told("_dashed")),
        "_named_day": F.when(named.isNotNull(), grab(F.col("_named"), NAMED_DAY, 1)),
        "_named_month": F.when(named.isNotNull(), grab(F.col("_named"), NAMED_DAY, 2)),
        "_named_year": F.when(named.isNotNull(), group1(F.col("_named"), NAMED_DAY, 3)),
        "_weekday": F.coalesce(weekday, F.when(F.col("_last_monday"), "lunes")),
        "_month_day": month_day,
        "_today": F.when(needs_today, arrival_date(received_at)),
    }


def days_ago(folded: Column) -> Column:
    """How many days back a spoken day word points."""
    past, now = has_any(folded, ["ayer", "yesterday"]), has_any(folded, ["hoy", "today"])
    return (
        F.when(past & folded.rlike(r"\banteayer\b|day before yesterday"), 2)
        .when(past & folded.rlike(r"\b(?:ayer|yesterday)\b"), 1)
        .when(now & folded.rlike(r"\b(?:hoy|today)\b"), 0)
    )


def original_date() -> Column:
    """The date the text states, as DD/MM/YYYY; relative words resolve against the arrival date.

    Works on the columns of ``date_parts``.
    """
    today = F.col("_today")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_WORDS]), F.col("_named_month"))
    year = F.coalesce("_named_year", F.year(today).cast("string"))
    named = F.concat_ws("/", pad2(F.col("_named_day")), pad2(month.cast("string")), year)
    back = F.pmod(
        F.weekday(today)
        - (F.array_position(F.array(*[F.lit(d) for d in WEEKDAY_WORDS]), F.col("_weekday")) - 1),
        F.lit(7),
    )
    shift = F.coalesce(
        F.col("_days_ago"),
        F.when(F.col("_weekday").isNotNull(), back),
        F.when(
            F.col("_month_day").isNull() & F.col("_this_period"),
            0,
        ),
    )
    spoken = F.date_format(F.date_sub(today, shift.cast("int")), "dd/MM/yyyy")
    return (
        F.when(F.col("_explicit").isNotNull(), F.col("_explicit"))
        .when(F.col("_named_month").isNotNull(), named)
        .when(spoken.isNotNull(), spoken)
        .when(
            F.col("_month_day").isNotNull(),
            F.concat(pad2(F.col("_month_day")), F.date_format(today, "/MM/yyyy")),
        )
    )


CLOCK = r"(\d{1,2}):(\d{2})\s*(am|pm|a\.m|p\.m)?"
HOUR_HALF = r"\b(\d{1,2})\s*(am|pm)\b"
HOUR_PART_OF_DAY = r"\b(\d{1,2}) de la (manana|tarde|noche)"


def _hour(hour: Column, half: Column) -> Column:
    """Hour 0-23 from a spoken hour and 'am', 'pm', 'manana', 'tarde', 'noche' or nothing."""
    number = hour.try_cast("int")
    late = half.isin("pm", "p.m", "tarde", "noche") & (number < 12)
    midnight = half.isin("am", "a.m", "noche") & (number == 12)
    return F.when(late, number + 12).when(midnight, F.lit(0)).otherwise(number)


def time_captures(folded: Column) -> dict[str, Column]:
    """The first form of a spoken time that fits, as a whole."""
    clock = F.when(has_any(folded, [":"]), grab(folded, CLOCK, 0))
    half, part = has_any(folded, ["am", "pm"]), has_any(folded, ["de la "])
    return {
        "_clock": clock,
        "_clock_half": F.when(half, grab(folded, HOUR_HALF, 0)),
        "_clock_part": F.when(part, grab(folded, HOUR_PART_OF_DAY, 0)),
    }


def time_parts() -> dict[str, Column]:
    """The spoken hour, its half of the day and the minutes, from the first form of ``time_captures`` that fits."""
    clock, half, part = told("_clock"), told("_clock_half"), told("_clock_part")

    def first(clock_group: int, other_group: int) -> Column:
        return (
            F.when(clock.isNotNull(), group1(F.col("_clock"), CLOCK, clock_group))
            .when(half.isNotNull(), grab(F.col("_clock_half"), HOUR_HALF, other_group))
            .when(part.isNotNull(), grab(F.col("_clock_part"), HOUR_PART_OF_DAY, other_group))
        )

    return {
        "_hour": first(1, 1),
        "_minutes": F.when(clock.isNotNull(), grab(F.col("_clock"), CLOCK, 2)),
        "_half": first(3, 2),
    }


def original_time(folded: Column) -> Column:
    """The time the text states, as HH:MM, from the columns of ``time_parts``."""
    hour = _hour(F.col("_hour"), F.col("_half")).cast("string")
    return (
        F.when(
            F.col("_hour").isNotNull(),
            F.concat(pad2(hour), F.lit(":"), F.coalesce("_minutes", F.lit("00"))),
        )
        .when(F.contains(folded, F.lit("mediodia")), "12:00")
        .when(F.contains(folded, F.lit("medianoche")), "00:00")
    )


# -- skip reason, description, confidence ------------------------------------------------
def skip_phrase(folded: Column) -> Column:
    """The reason of the first telling phrase in the text."""
    reason = F.when(F.contains(folded, F.lit("recuerda ")) & folded.rlike(REMINDER), SKIP_PHRASES[-1][0])
    for name, phrases in reversed(SKIP_PHRASES):
        hit = has_any(folded, phrases)
        if name in SKIP_PATTERNS:
            words, pattern = SKIP_PATTERNS[name]
            hit = hit | (has_any(folded, words) & folded.rlike(pattern))
        reason = F.when(hit, name).otherwise(reason)
    return reason


def skip_reason(folded: Column, phrase: Column | None = None) -> Column:
    """Why a text is no transaction: a telling phrase, unless the text states a payment or receipt with its amount.

    A text that opens as a spending summary is one even so. ``phrase`` may give the column that holds ``skip_phrase``.
    """
    reason = skip_phrase(folded) if phrase is None else phrase
    summary = has_any(folded, ["resumen"]) & folded.rlike(SUMMARY)
    return F.when(summary, SKIP_PHRASES[0][0]).when(reason.isNotNull() & ~folded.rlike(DONE_WITH_AMOUNT), reason)


MERCHANT = [
    r"(?i)\sen (.+?) con tu",
    r"(?i)\sen ([^,.\n]+)",
]
NOT_DESCRIPTION = (
    r"(?:el )?\d{1,2}/\d{1,2}/\d{4}|(?:el )?\d{4}-\d{2}-\d{2}"
    r"|(?:a las )?\d{1,2}:\d{2}\s*(?:am|pm)?"
    r"|(?:a las )?\b\d{1,2}\s*(?:am|pm)\b"
    r"|(?:a las )?\b\d{1,2} de la (?:ma[nñ]ana|tarde|noche)"
    rf"|\b\d{{1,2}} de (?:{MONTHS})(?: del? \d{{4}})?"
    rf"|\bel (?:{WEEKDAYS}|mi[eé]rcoles|s[aá]bado)\b"
    r"|\bel \d{1,2}\b"
    r"|day before yesterday|last monday|(?:de )?\b(?:hoy|today|anteayer|ayer|yesterday)\b"
    r"|esta semana|this week|este mes|this month|mediod[ií]a|medianoche"
    r"|\b(?:con|en) efectivo\b"
    r"|\$?\s*\d[\d.,]*\s*(?:mil\b|k\b)?"
)
#: How each alternative begins: every other position of a text is passed over at one glance.
FIND_NOT_DESCRIPTION = (
    r"(?=[0-9$\seadlhtymc])(?=\$?\s*\d|e[lns]|a[ ny]|d[ea]|la|ho|t[oh]|ye|me|co)(?:" + NOT_DESCRIPTION + ")"
)
LOOSE_ENDS = r"^(?:\s*\b(?:en|in|for|de|para|por|bought|el|a)\b)+\s*|\s+(?:en|in|for|de|para|por|el|a)\s*$"


def merchant(text: Column) -> Column:
    return F.coalesce(*[group1(text, p) for p in MERCHANT])


def remainder(text: Column) -> Column:
    """A hand-typed text without its amounts, dates, times and connecting words."""
    rest = F.regexp_replace(F.lower(text), FIND_NOT_DESCRIPTION, " ")
    rest = F.regexp_replace(F.trim(rest), LOOSE_ENDS, "")
    return F.trim(F.regexp_replace(rest, r"\s+", " "))


def description(text: Column, source_col: Column, phone: Column) -> Column:
    place = F.when(source_col != "manual", F.trim(merchant(text)))
    is_transfer = contains_any(text, ["transferiste", "enviaste", "transferencia"])
    to = F.coalesce(F.concat(F.lit(" a "), phone), F.lit(""))
    return F.coalesce(
        place, F.when(is_transfer, F.concat(F.lit("Transferencia"), to)).otherwise(remainder(text))
    )


def confidence(folded: Column, source_col: Column, skipped: Column, date: Column) -> Column:
    """95 for a skip, 100 for a bank template, 90 for a telling hand-typed text, else 85."""
    telling = date.isNotNull() | F.contains(folded, F.lit("efectivo")) | folded.rlike(FIND_MERCHANT)
    return (
        F.when(skipped.isNotNull(), 95)
        .when(source_col != "manual", 100)
        .when(telling, 90)
        .otherwise(85)
    )
