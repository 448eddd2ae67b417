"""The worked parse examples, skip reasons and spoken dates."""

import datetime as dt

import pytest

from tallywell.operators import parse

ARRIVAL = dt.datetime(2026, 2, 16, 17, 0)  # noon on a Monday, local time
FIELDS = ["is_transaction", "skip_reason", "amount", "description", "category", "bank", "payment_type",
          "parsed_source", "confidence", "original_date", "original_time", "last_four", "account_type"]

EXAMPLES = [
    ("20000 en almuerzo",
     (True, None, 20000, "almuerzo", "restaurant", "cash", "cash", "manual", 85, None, None, None, None)),
    ("Bancolombia: Compraste $119.000,00 en CODASHOP con tu T.Deb *7799, el 23/11/2024 a las 19:47",
     (True, None, 119000, "CODASHOP", "software", "bancolombia", "debit", "bancolombia_email", 100,
      "23/11/2024", "19:47", "7799", "checking")),
    ("50k en rappi",
     (True, None, 50000, "rappi", "restaurant", "cash", "cash", "manual", 90, None, None, None, None)),
    ("Pan con efectivo de hoy 2500",
     (True, None, 2500, "pan", "groceries", "cash", "cash", "manual", 90, "16/02/2026", None, None, None)),
    ("Bancolombia: tus gastos entre diciembre y enero cambiaron en $1.615.035",
     (False, "spending_summary", 0, "", "missing", "bancolombia", "debit", "bancolombia_email", 95,
      None, None, None, None)),
]


@pytest.fixture(scope="module")
def parse_texts(spark):
    def run(texts, fields):
        rows = [(i, t, ARRIVAL) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, text string, received_at timestamp_ntz")
        return [tuple(r) for r in parse.parse_messages(df).orderBy("i").select(*fields).collect()]

    return run


def test_worked_examples(parse_texts):
    got = parse_texts([t for t, _ in EXAMPLES], FIELDS)
    assert got == [want for _, want in EXAMPLES]


def test_amounts(parse_texts):
    cases = {
        "$50,000": 50000, "50mil para lunch": 50000, "1.5k taxi": 1500, "$20k pan": 20000,
        "Pagaste $1.615.035 en X": 1615035, "el 15 pague 3.000": 3000, "a las 10:30 gaste 700": 700,
        "a 3104633357 4500": 4500, "$10.50 cafe": 10.5, "nada": None,
    }
    got = [r[0] for r in parse_texts(list(cases), ["amount"])]
    assert [None if a is None else float(a) for a in got] == [None if v is None else float(v) for v in cases.values()]


def test_skip_reasons(parse_texts):
    cases = {
        "Consulta de saldo en cajero": "balance_inquiry", "Tu clave dinámica es 123456": "otp_code",
        "Código de verificación 1": "otp_code", "Activa tu tarjeta de credito Bancolombia": "promotional",
        "Recuerda pagar tu factura antes del 15": "informational", "Tu cuenta ha sido bloqueada": "informational",
        "Nequi: Pagaste $5 en X. Saldo: $3": None,
    }
    assert [r[0] for r in parse_texts(list(cases), ["skip_reason"])] == list(cases.values())


def test_amounts_beside_balances_codes_and_summaries(parse_texts):
    cases = {
        "Bancolombia: Compra por $50.000 en EXITO. Tu saldo disponible es 5": (True, 50000, "EXITO", "groceries"),
        "Nequi: Recibiste $500.000 de JUAN. Tu saldo disponible es $1.000.000": (True, 500000, None, None),
        "Tu saldo es $20.000": (False, 0, "", "missing"),
        "tu codigo OTP es 123456": (False, 0, "", "missing"),
        "Resumen: gastaste $500.000 en comida este mes": (False, 0, "", "missing"),
    }
    got = parse_texts(list(cases), ["is_transaction", "amount", "description", "category"])
    for row, want in zip(got, cases.values()):
        assert [g for g, w in zip(row, want) if w is not None] == [w for w in want if w is not None]


def test_spoken_dates(parse_texts):
    cases = {
        "5k pan ayer": "15/02/2026", "5k pan anteayer": "14/02/2026", "5k el lunes": "16/02/2026",
        "5k el martes": "10/02/2026", "5k el miércoles": "11/02/2026", "5k el domingo": "15/02/2026",
        "5k el 15": "15/02/2026", "5k 7 de febrero": "07/02/2026", "5k 7 de marzo de 2025": "07/03/2025",
        "5k esta semana": "16/02/2026", "5k today": "16/02/2026", "5k last Monday": "16/02/2026",
        "5k 3 de la tarde": None, "pagaste 5k": None,
    }
    assert [r[0] for r in parse_texts(list(cases), ["original_date"])] == list(cases.values())


def test_spoken_times(parse_texts):
    cases = {
        "5k a las 10:30pm": "22:30", "5k 3 de la tarde": "15:00", "5k 8 de la mañana": "08:00",
        "5k mediodía": "12:00", "5k medianoche": "00:00", "5k 12am": "00:00", "5k 12pm": "12:00", "5k pan": None,
    }
    assert [r[0] for r in parse_texts(list(cases), ["original_time"])] == list(cases.values())


def test_longest_word_wins(parse_texts):
    texts = ["30k uber eats", "30k uber", "30k para", "30k apple store", "30k cosa"]
    assert [r[0] for r in parse_texts(texts, ["category"])] == ["restaurant", "taxi", "missing", "software", "missing"]


def test_rejects(spark):
    rows = [("0", " x", "c", None), ("5", "  ", "c", True), ("5", "x", "", True), ("5", "x", "c", None),
            ("-1", "", "", False), (None, "x", "c", True)]
    df = spark.createDataFrame(rows, "amount string, description string, category string, is_transaction boolean")
    df = df.withColumn("amount", df.amount.cast("decimal(15,2)"))
    got = [(r.reject_reason, r.is_transaction) for r in parse.validate_parsed(df).collect()]
    assert got == [("Invalid amount", True), ("Missing description", True), ("Missing category", True),
                   (None, True), (None, False), ("Invalid amount", True)]


def test_only_explicit_false_skips(spark):
    df = spark.createDataFrame([(True,), (None,), (False,)], "is_transaction boolean")
    assert parse.transactions_only(df).count() == 2


def test_event_time_choice(spark):
    rows = [("15/01/2024", "10:00"), ("15/01/2024", None), (None, "10:00"), ("31/02/2024", "10:00"), ("x", None)]
    df = spark.createDataFrame([(d, t, ARRIVAL) for d, t in rows], "original_date string, original_time string, received_at timestamp_ntz")
    got = [(str(r.date) if r.date else None, r.time) for r in parse.with_event_time(df).collect()]
    assert got == [("2024-01-15", "10:00"), ("2024-01-15", "12:00"), ("2026-02-16", "12:00"), (None, "10:00"), ("2026-02-16", "12:00")]
