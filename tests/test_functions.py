"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from tallywell.functions import eventtime, present, transfer
from tallywell.operators import statement
from tallywell.operators.dedup import cache_key
from tallywell.sources import messages


def test_phone(evaluate):
    texts = ["Transferiste a *3104633357", "la cuenta *3104633357", "enviaste a 3104633357 desde tu cuenta",
             "Compraste en almacen", "AL 3104633357.", "*31046333579", "cuenta3104633357é", None]
    want = ["3104633357"] * 3 + [None, "3104633357", None, "3104633357", None]
    assert evaluate(transfer.phone, texts) == want


def test_first_phone_pattern_wins(evaluate):
    assert evaluate(transfer.phone, ["a 1111111111 cuenta *2222222222"]) == ["2222222222"]


def test_origin_account(evaluate):
    texts = ["desde tu cuenta 2651", "cuenta 2651 a la cuenta", "Compraste en tienda", "*7799, el 3"]
    assert evaluate(transfer.origin_account, texts) == ["2651", "2651", None, "7799"]


def test_transfer_words(evaluate):
    texts = ["Transferiste $50,000", "Enviaste $100,000 a cuenta", "Se realizo transferencia",
             "Compraste en restaurante", "ENVÍO A Juan"]
    assert evaluate(transfer.is_transfer, texts) == [True, True, True, False, True]


@pytest.mark.parametrize("given, want", [
    ("15/01/2024", "15/01/2024"), ("15/13/2024", None), ("32/01/2024", None), ("31/02/2024", "31/02/2024"),
    ("1/2/2024", "01/02/2024"), ("1/25/2024", "25/01/2024"), ("25/1/2024", "25/01/2024"),
    ("1/45/2024", "45/01/2024"), ("0/5/2024", "00/05/2024"), ("2024-03-07", "07/03/2024"),
    ("2024-13-01", None), ("1999-01-01", None), ("15/01/24", None), (" 15/01/2024 ", "15/01/2024"),
    ("", None), (None, None), ("mañana", None), ("1/2/2101", None),
])
def test_fix_date(evaluate, given, want):
    assert evaluate(eventtime.fix_date, [given]) == [want]


def test_fix_time(evaluate):
    texts = ["14:30", "24:00", "8:30", " 8:05 ", "12:60", "8:5", "08:30:00", None, ""]
    want = ["14:30", None, "08:30", "08:05", None, None, None, None, None]
    assert evaluate(eventtime.fix_time, texts) == want


def test_date_format(evaluate):
    days = ["15/01/2024", "03/07/2024", "31/12/2024", None]
    assert evaluate(eventtime.to_iso, days) == ["2024-01-15", "2024-07-03", "2024-12-31", None]
    assert evaluate(eventtime.to_slashed, ["2024-01-15"]) == ["15/01/2024"]


def test_arrival_is_local(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 03:15:00' AS ts").select(
        eventtime.arrival_date(F.col("ts")).cast("string"), eventtime.arrival_time(F.col("ts")),
        eventtime.usage_month(F.col("ts")), eventtime.epoch_second(F.col("ts")),
    ).head()
    assert tuple(row) == ("2023-12-31", "22:15", "2024-01", 1704078900)


def test_formatting(evaluate):
    assert evaluate(present.capitalise_words, ["hello world", "HELLO", "", None]) == ["Hello World", "Hello", "", ""]
    assert evaluate(present.confidence_label, [95.7, 80.0, 0.5, None], "double") == ["96%", "80%", "1%", "N/A"]
    assert evaluate(present.pesos, ["1500000", "0", "-1234.50"]) != []
    shown = evaluate(lambda c: present.pesos(c.cast("decimal(15,2)")), ["1500000", "0", "-1234.50", "2.5"])
    assert shown == ["$ 1.500.000", "$ 0", "-$ 1.235", "$ 3"]
    assert evaluate(present.slug, ["Food & Drink"]) == ["food-&-drink"]


def test_value_checks(evaluate):
    assert evaluate(present.is_valid_date, ["2024-01-15", "15/01/2024", "2024-13-01", "", None]) == [True] + [False] * 4
    assert evaluate(present.is_valid_time, ["14:30", "00:00", "23:59", "24:00", "12:60", "9:00"]) == [True] * 3 + [False] * 3
    amounts = [100.0, 0.01, 0.0, -5.0, float("inf"), float("nan"), None]
    assert evaluate(present.is_valid_amount, amounts, "double") == [True, True] + [False] * 5
    mails = ["a@b.co", "a b@c.co", "a@b", "@b.co", "", None]
    assert evaluate(present.is_valid_email, mails) == [True] + [False] * 5


def test_cache_key(evaluate):
    a, b, c = evaluate(cache_key, ["Compra 20k", "  compra 20K \n", "otra"])
    assert a == b != c and a.startswith("gemini:") and len(a) == 71


def test_email_excerpt(evaluate):
    bodies = [
        "Hola\nBancolombia: Compraste $50.000 en EXITO con tu T.Deb *7799\nGracias",
        "Pagaste $10 en\nX bancolombia",
        "aviso\n tu saldo Bancolombia 1.000 \nfin",
        "Bancolombia te saluda",
        "Bancolombia: Retiraste $5 en " + "x" * 300,
    ]
    got = evaluate(messages.email_excerpt, bodies)
    assert got[0] == "Bancolombia: Compraste $50.000 en EXITO con tu T.Deb *7799"
    assert got[1] == "Pagaste $10 en"
    assert got[2] == "tu saldo Bancolombia 1.000"
    assert got[3] is None and len(got[4]) == 200


def test_chat_text(evaluate):
    texts = ["/gasto 20k almuerzo", "/expense@bot  50k uber", "/gasto", "20k pan", "/gastos 5k", "/gasto a\nb"]
    assert evaluate(messages.chat_text, texts) == ["20k almuerzo", " 50k uber", "", "20k pan", "/gastos 5k", "a\nb"]


def test_statement_fields(evaluate):
    amounts = evaluate(statement.statement_amount, ["-12.50 COP", "7", ".5x", "abc", "", None, "+3."])
    assert [None if a is None else float(a) for a in amounts] == [12.5, 7, 0.5, None, None, None, 3]
    days = evaluate(lambda c: statement.statement_date(c).cast("string"), 
                    ["2024-02-29", "2/3/2024", "2024-01-05T10:00:00", "no", "2024-01-05T23:30:00.000Z", "2024-01-05T23:30:00-05:00", "2024-01-05 10:00"])
    assert days == ["2024-02-29", "2024-02-03", "2024-01-05", None, "2024-01-05", "2024-01-06", "2024-01-05"]
    assert evaluate(statement.statement_category, ["Rent", "Salary", "?", None]) == ["home", "salary", "other", "other"]
    assert evaluate(statement.statement_institution, ["Mi NEQUI", "Efectivo", "x", None]) == ["nequi", "cash", "bancolombia", "bancolombia"]


def test_a_stated_payment_wins_over_skip_phrases(evaluate):
    from tallywell.functions import parse
    from tallywell.functions.text import fold

    payments = [
        "Nequi: Pagaste $50.000 en RAPPI. Tu saldo disponible es $20.000",
        "Bancolombia: Compraste $119.000,00 en EXITO con tu T.Deb *7799, el 25/11/2025. Recuerda no compartir tu clave dinamica",
        "Bancolombia: Compraste $119.000,00 en EXITO. Activa tu tarjeta debito virtual",
        "Bancolombia: Transferiste $20,000 a la cuenta *3104633357. Tu saldo disponible es $1.000",
        "20k almuerzo, recuerda guardar el recibo",
        "Bancolombia: Compra por $50.000 en EXITO. Tu saldo disponible es 5",
        "Recibiste $500.000 de JUAN. Tu saldo disponible es $1.000.000",
        "Nequi: Recibiste una transferencia por $20.000 de ANA. Tu saldo es $30.000",
        "Bancolombia le informa compra aprobada por COP 50.000 en EXITO. Nunca compartas tu clave dinámica",
        "Te consignaron 80.000 en tu cuenta. Tu saldo disponible es $90.000",
        "Realizaste un pago por $30.000 a EPM. Tu extracto está disponible",
        "gastaste 20k en almuerzo", "pague el saldo del mes 20k", "resumen del libro 20k",
    ]
    others = {
        "Bancolombia: tus gastos entre diciembre y enero cambiaron en $1.615.035": "spending_summary",
        "Consulta de saldo en cajero": "balance_inquiry",
        "Tu saldo disponible es $20.000": "balance_inquiry",
        "Tu clave dinamica es 123456": "otp_code",
        "Activa tu tarjeta de credito Bancolombia": "promotional",
        "Recuerda pagar tu factura antes del 15": "informational",
        "Tu cuenta ha sido bloqueada": "informational",
        "Tu saldo es $20.000": "balance_inquiry",
        "Bancolombia: el saldo de tu cuenta es $20.000": "balance_inquiry",
        "tu codigo OTP es 123456": "otp_code",
        "Tu código de retiro es 123456": "otp_code",
        "Tu código OTP es 123456 para la compra por $50.000": "otp_code",
        "Recibiste un código de verificación para tu compra de $50.000": "otp_code",
        "Resumen: gastaste $500.000 en comida este mes": "spending_summary",
        "Nequi: Resumen mensual. Pagaste $500.000 en RAPPI": "spending_summary",
        "Has gastado $80.000 en taxi esta semana": "spending_summary",
        "Recuerda que tu pago de $50.000 vence el 15": "informational",
        "Tu pago mínimo es de $50.000. Tu extracto está disponible": "informational",
    }
    got = evaluate(lambda t: parse.skip_reason(fold(t)), payments + list(others))
    assert got == [None] * len(payments) + list(others.values())


def test_bulk_lines_commands_and_mail_lines(spark):
    from tallywell.sources import messages as src

    rows = spark.createDataFrame([(1, "20k pan\r\n\r\n \t\r\n30k uber")], "message_id long, raw string")
    assert [r.text for r in src.bulk_messages(rows, "raw").collect()] == ["20k pan\r", "30k uber"]
    chats = ["/gasto 20k pan", "/gasto\n20k pan", "/start", "/help@bot x", "/startup 20k", "/gasto", "20k pan"]
    df = spark.createDataFrame(list(enumerate(chats)), "message_id long, text string")
    out = {r.message_id: (r.text, r.problem) for r in src.chat_messages(df).collect()}
    assert out[0] == ("20k pan", None) and out[1] == ("pan", None) and out[6] == ("20k pan", None)
    assert out[2][1] == out[3][1] == src.REJECT_SERVICE and out[4][1] is None and out[5][1] == src.REJECT_TEXT
    mail = spark.createDataFrame([(1, "Hola\r\n Bancolombia le informa 5 \r\nx", None, None)], "message_id long, body string, text string, subject string")
    assert [r.text for r in src.email_messages(mail).collect()] == ["Bancolombia le informa 5"]


def test_wide_trim_looks_at_the_ends_alone(evaluate):
    from tallywell.fixed_values import WIDE_SPACE
    from tallywell.functions.text import WIDE_SPACES, wide_trim

    texts = [*(f"{c}a{c}b{c}{c}" for c in WIDE_SPACES), WIDE_SPACES, "", "a", None]
    by_pattern = evaluate(lambda t: F.regexp_replace(t, f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", ""), texts)
    assert evaluate(wide_trim, texts) == by_pattern
    assert evaluate(wide_trim, ["x \x85"]) == ["x \x85"]  # no white space of the pattern, so nothing before it is at the end
