"""Transfer fields in a message: phone, origin account, and whether it is a transfer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell.fixed_values import ORIGIN_ACCOUNT_PATTERNS, PHONE_PATTERNS, TRANSFER_KEYWORDS
from tallywell.functions.text import contains_any, first_match


def phone(text: Column) -> Column:
    return F.when(text.rlike(r"\d{10}"), first_match(text, PHONE_PATTERNS))


def plain_phone(number: Column) -> Column:
    """Without the one leading star some senders write."""
    return F.regexp_replace(number, r"^\*", "")


def origin_account(text: Column) -> Column:
    candidate = F.contains(text, F.lit("*")) | text.rlike(r"(?i)cuenta\s")
    return F.when(candidate, first_match(text, ORIGIN_ACCOUNT_PATTERNS))


def is_transfer(text: Column) -> Column:
    return contains_any(text, TRANSFER_KEYWORDS)
