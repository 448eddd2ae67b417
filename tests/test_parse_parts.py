"""The parse by parts: the quicker patterns find what the published ones find, and a reader pays for what it asks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywell.functions import parse as rules
from tallywell.functions.text import fold
from tallywell.operators import parse

ARRIVAL = dt.datetime(2026, 2, 16, 17, 0)
TEXTS = [
    *rules.WORD_TO_SLUG, "disney+ y disney plus", "uber eats, uber y ubers", "apple store apple", "paneer pan", "xd1 d1", "",
    "el 15 de enero del 2024 a las 3 pm pan 20 mil", "day before yesterday lunch $ 20k", "de hoy el lunes 3 de la tarde", "mediodía con efectivo 2500",
    "esta semana este mes this week last monday", "anteayer a las 10:30pm en efectivo", "Él 2024-01-31 cafe\t 5", "a 1/2/2024 b", "elote 7 k kk",
]


def test_words_by_first_letter_are_the_same_words(evaluate):
    for quick, published in ((rules.FIND_WORD, rules.ANY_WORD), (rules.FIND_MERCHANT, rules.ANY_MERCHANT)):
        def found(pattern):
            return evaluate(lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), TEXTS)

        assert found(quick) == found(published)


def test_positions_passed_over_hold_nothing(evaluate):
    def cut(pattern):
        return evaluate(lambda t: F.regexp_replace(F.lower(t), pattern, "_"), TEXTS)

    assert cut(rules.FIND_NOT_DESCRIPTION) == cut(rules.NOT_DESCRIPTION)


def test_fold_of_plain_and_accented_texts(evaluate):
    assert evaluate(fold, ["AbC", "CAFÉ ñandú €", "", None]) == ["abc", "cafe nandu €", "", None]


def test_only_the_wanted_fields(spark):
    rows = spark.createDataFrame([(i, t, ARRIVAL) for i, t in enumerate(TEXTS)], "i int, text string, received_at timestamp_ntz")
    whole = parse.parse_messages(rows)
    fields = [c for c in whole.columns if c not in rows.columns]
    want = {r["i"]: r for r in whole.collect()}
    for only in [["bank", "last_four"], ["confidence"], ["category"], ["amount", "original_time"], fields]:
        got = parse.parse_messages(rows, only)
        assert set(got.columns) == {*rows.columns, *only}
        assert all(r[c] == want[r["i"]][c] for r in got.collect() for c in only)
    plan = parse.parse_messages(rows, ["bank"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
    with pytest.raises(ValueError):
        parse.parse_messages(rows, ["no_such_field"])
