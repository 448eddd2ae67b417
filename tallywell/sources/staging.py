"""Ledger tables derived from the generic test tables.

The test tables hold no bank messages, so each ledger table is a fixed projection of one of
them. Where the SQL is plain enough it is kept as text that Spark and DuckDB both run, and
the oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators.categories import default_template, provision_categories
from tallywell.plans.once import once
from tallywell.sources.messages import spread


SOURCES = {
    "account": ["customer"],
    "category": ["nation", "region"],
    "txn": ["orders", "customer"],
    "message": ["events"],
    "parse_request": ["events"],
    "import_row": ["lineitem", "nation"],
    "subscription": ["events"],
    "usage_stored": ["events"],
}

STAGING = {
    "account": """
SELECT CAST(c_custkey AS STRING) AS account_id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'checking' WHEN 'BUILDING' THEN 'savings'
    WHEN 'FURNITURE' THEN 'credit_card' WHEN 'HOUSEHOLD' THEN 'credit' ELSE 'cash' END AS type,
  CASE c_custkey % 4 WHEN 0 THEN 'bancolombia' WHEN 1 THEN 'nequi' WHEN 2 THEN 'daviplata' ELSE 'cash' END AS institution,
  CASE WHEN c_custkey % 11 <> 5 THEN lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS last_four,
  'COP' AS currency,
  CASE WHEN c_custkey % 29 <> 3 THEN CAST(c_acctbal AS DECIMAL(15,2)) END AS balance,
  c_acctbal >= 0 AS is_active, c_custkey % 3 = 0 AS is_default,
  CASE WHEN c_custkey % 53 = 7 THEN CAST('2024-01-01' AS DATE) END AS deleted_at
FROM {customer}""",
    "category": """
SELECT CAST(n_nationkey AS STRING) AS category_id, CAST(n_nationkey % 7 AS BIGINT) AS user_id,
  n_name AS name, lower(replace(n_name, '_', '-')) AS slug,
  CASE n_nationkey % 3 WHEN 0 THEN 'expense' WHEN 1 THEN 'income' ELSE 'transfer' END AS type,
  'r' || CAST(n_regionkey AS STRING) AS parent_id, n_nationkey % 6 <> 5 AS is_active,
  n_nationkey % 2 = 0 AS is_default,
  CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'want' WHEN 2 THEN 'need' ELSE 'must' END AS spending_nature,
  CASE WHEN n_nationkey % 13 = 6 THEN CAST('2024-01-01' AS DATE) END AS deleted_at
FROM {nation}
UNION ALL
SELECT 'r' || CAST(r_regionkey AS STRING), CAST(r_regionkey % 7 AS BIGINT), r_name,
  lower(replace(r_name, ' ', '-')), 'expense', NULL, true, true, 'none', NULL
FROM {region}""",
    "txn": """
SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS seq, CAST(c_nationkey AS BIGINT) AS user_id,
  CAST(o_custkey AS STRING) AS account_id, CAST(o_orderdate AS DATE) AS date,
  lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS time,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'expense' WHEN 'O' THEN 'income' ELSE 'transfer' END AS type,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0
    THEN CAST((o_custkey * 7 + 1) % (SELECT count(*) FROM {customer}) AS STRING) END AS transfer_to_account_id,
  CAST(NULL AS STRING) AS transfer_id, CAST(NULL AS STRING) AS notes,
  CASE o_orderkey % 8 WHEN 0 THEN 'Almuerzo en Restaurante' WHEN 1 THEN 'Nomina Enero 2024'
    WHEN 2 THEN 'RAPPI pedido' WHEN 3 THEN 'UBER viaje' WHEN 4 THEN 'Netflix mensual'
    WHEN 5 THEN 'Compra Exito' WHEN 6 THEN 'Pago EPM' ELSE 'Retiro cajero' END AS description,
  'Orden ' || o_orderpriority || ' por $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS raw_text,
  CAST(o_orderkey % 25 AS STRING) AS category_id, o_orderpriority AS payment_method,
  CASE o_orderkey % 4 WHEN 0 THEN 'bancolombia_email' WHEN 1 THEN 'nequi_sms' WHEN 2 THEN 'manual' ELSE 'api' END AS source,
  CAST(o_orderkey % 104 AS INT) AS confidence,
  CASE WHEN o_orderkey % 41 = 1 THEN 'pending_review' END AS duplicate_status,
  CASE WHEN o_orderkey % 41 = 1 THEN CAST(o_orderkey - 1 AS STRING) END AS duplicate_of,
  CAST(o_orderkey % 7 AS STRING) AS import_id, o_orderdate AS created_at, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate END AS deleted_at
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "message": """
SELECT event_id AS message_id,
  CASE event_type WHEN 'view' THEN 'chat' WHEN 'purchase' THEN 'email' WHEN 'signup' THEN 'parse' ELSE 'api' END AS channel,
  user_id % 25 AS user_id,
  CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN NULL
    WHEN event_type = 'view' AND event_id % 31 = 7 THEN '/help' WHEN event_type = 'view' AND event_id % 17 = 3 THEN '/gasto' || chr(10) || line
    WHEN event_type = 'view' AND event_id % 3 = 0 THEN '/gasto ' || line ELSE line END AS text,
  CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN line END AS body,
  CAST(NULL AS STRING) AS subject,
  CASE WHEN event_id % 3 = 0 THEN 'sms' END AS source, ts AS received_at
FROM (SELECT event_id, event_type, user_id, ts,
  CASE event_id % 10
    WHEN 0 THEN 'Bancolombia: Compraste $' || th || '.000,00 en ' || shop || ' con tu T.Deb *' || four || ', el ' || slashed || ' a las 19:47'
    WHEN 1 THEN 'Bancolombia: Transferiste $' || th || ',000 a la cuenta *31' || lpad(CAST(user_id AS STRING), 8, '0') || ' desde tu cuenta ' || four
    WHEN 2 THEN 'Bancolombia: Realizaste una transferencia por $' || th || ',000 en sucursal virtual'
    WHEN 3 THEN 'Nequi: Pagaste $' || th || '.000 en ' || shop || '. Saldo: $' || th || '.500'
    WHEN 4 THEN th || 'k en ' || lower(shop)
    WHEN 5 THEN th || 'mil almuerzo ' || spoken
    WHEN 6 THEN 'Tu clave dinamica es 123456'
    WHEN 7 THEN 'Bancolombia: tus gastos entre diciembre y enero cambiaron en $1.615.035'
    WHEN 8 THEN CASE user_id % 8 WHEN 0 THEN 'Consulta de saldo en cajero' WHEN 1 THEN 'Activa tu tarjeta de credito Bancolombia'
      WHEN 2 THEN 'Recuerda pagar tu factura antes del 15' WHEN 3 THEN 'Nequi: Pagaste $' || th || '.000 en ' || shop || '. Tu saldo disponible es $20.000'
      WHEN 4 THEN 'Bancolombia: Compraste $' || th || '.000,00 en EXITO con tu T.Deb *' || four || '. Recuerda no compartir tu clave dinamica'
      WHEN 5 THEN 'Bancolombia: Compraste $' || th || '.000,00 en EXITO con tu T.Deb *' || four || '. Activa tu tarjeta debito virtual'
      WHEN 6 THEN CASE CAST(floor(event_id / 10) AS BIGINT) % 6
        WHEN 0 THEN 'Bancolombia: Compra por $' || th || '.000 en EXITO. Tu saldo disponible es $5.000'
        WHEN 1 THEN 'Nequi: Recibiste $' || th || '.000 de JUAN. Tu saldo disponible es $1.000.000'
        WHEN 2 THEN 'Tu saldo es $' || th || '.000' WHEN 3 THEN 'Tu codigo OTP es 123456'
        WHEN 4 THEN 'Resumen: gastaste $' || th || '.000 en comida este mes'
        ELSE 'Bancolombia le informa pago exitoso por $' || th || '.000 en ' || shop || '. Actualizamos tus datos' END
      ELSE 'Pan con efectivo de hoy ' || th || '00' END
    ELSE 'Hola cliente' || chr(13) || chr(10) || 'Bancolombia: Retiraste $' || th || '.000 en CAJERO ' || CAST(user_id % 7 AS STRING)
      || ' con tu Credito *' || four || ', el ' || slashed || chr(13) || chr(10) || 'Gracias' END AS line
  FROM (SELECT event_id, event_type, user_id, ts,
    CAST(CAST(floor(value / 10) AS INT) * 10 + 10 AS STRING) AS th,
    lpad(CAST((event_id * 7 % 400) * 4 AS STRING), 4, '0') AS four,
    lpad(CAST(day(ts) AS STRING), 2, '0') || '/' || lpad(CAST(month(ts) AS STRING), 2, '0') || '/' || CAST(year(ts) AS STRING) AS slashed,
    CASE user_id % 9 WHEN 0 THEN 'CODASHOP' WHEN 1 THEN 'RAPPI' WHEN 2 THEN 'UBER EATS' WHEN 3 THEN 'UBER' WHEN 4 THEN 'EXITO'
      WHEN 5 THEN 'NETFLIX' WHEN 6 THEN 'TERPEL' WHEN 7 THEN 'FARMATODO' ELSE 'TIENDA LUNA' END AS shop,
    CASE (event_id * 3 + user_id) % 12 WHEN 0 THEN 'hoy' WHEN 1 THEN 'ayer a las 10:30pm' WHEN 2 THEN 'anteayer' WHEN 3 THEN 'el lunes 3 de la tarde'
      WHEN 4 THEN 'el 15' WHEN 5 THEN '7 de febrero' WHEN 6 THEN 'esta semana mediodia' WHEN 7 THEN 'el 2024-01-31'
      WHEN 8 THEN 'el 31/02/2024' WHEN 9 THEN '1/25/2024 8:05' WHEN 10 THEN 'el domingo medianoche' ELSE 'con el equipo' END AS spoken
    FROM {events}) AS parts) AS lines""",
    "parse_request": """
SELECT event_id AS request_id, user_id, ts AS received_at
FROM {events} WHERE event_type IN ('click', 'view')""",
    "import_row": """
SELECT CAST(l_suppkey % 9 AS STRING) AS import_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS row_id, l_orderkey % 25 AS user_id,
  CASE l_partkey % 10 WHEN 0 THEN 'someday'
    WHEN 1 THEN CAST(month(l_shipdate) AS STRING) || '/' || CAST(day(l_shipdate) AS STRING) || '/' || CAST(year(l_shipdate) AS STRING)
    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS `Date`,
  CASE l_partkey % 17 WHEN 0 THEN 'n/a' WHEN 1 THEN '0'
    WHEN 2 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS STRING) || ' COP'
    ELSE CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS STRING) END AS `Amount`,
  CASE l_partkey % 6 WHEN 0 THEN 'Food & Drink' WHEN 1 THEN 'Transport' WHEN 2 THEN 'Bills & Utilities'
    WHEN 3 THEN 'Salary' WHEN 4 THEN 'Pets' ELSE n_name END AS `Category`,
  CASE l_orderkey % 4 WHEN 0 THEN 'Mi Bancolombia' WHEN 1 THEN 'NEQUI' WHEN 2 THEN 'Efectivo' ELSE 'Otra' END AS `Account`,
  CASE WHEN l_linenumber % 2 = 0 THEN 'compra ' || l_returnflag || ' EN TIENDA' END AS `Note`,
  CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus END AS `Labels`
FROM {lineitem} LEFT JOIN {nation} ON n_nationkey = l_suppkey % 25""",
    "subscription": """
SELECT user_id, CASE WHEN user_id % 5 IN (0, 1) THEN 'pro' ELSE 'free' END AS plan,
  CASE WHEN user_id % 5 = 1 THEN 'canceled' ELSE 'active' END AS status
FROM (SELECT DISTINCT user_id FROM {events}) AS users""",
    "usage_stored": """
SELECT user_id, month, CAST(user_id % 20 AS INT) AS ai_parses_used, CAST(15 AS INT) AS ai_parses_limit,
  CAST(user_id % 50 AS INT) AS transactions_count, CAST(50 AS INT) AS transactions_limit
FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN '2024-01' ELSE '2022-11' END AS month
  FROM {events} WHERE user_id % 3 = 0) AS users""",
}

# (rule suffix, name, priority, active for users divisible by, prompt, phone, target, type, logic,
#  conditions, actions, ai prompt, deleted); @U is the user id, @P a phone of the user's own
RULE_TEMPLATES = [
    ("01", "Comida", 100, 1, "Pedidos son restaurante", None, None, "general", "or",
     '{"description_contains":["restaurante","RAPPI","rappi"]}', '{"set_category":"3","add_note":"comida"}', "mis pedidos", False),
    ("02", "Nomina", 90, 1, "", None, None, "general", "or",
     '{"description_regex":"^Nomina.*"}', '{"set_type":"income","set_category":"7"}', None, False),
    ("03", "Viajes", 80, 1, None, None, None, "general", "and",
     '{"description_contains":["uber","viaje"]}', '{"set_category":"5","set_account":"@U"}', None, False),
    ("04", "Cuenta propia", 50, 1, None, None, None, "general", "or",
     '{"from_account":"@U"}', '{"add_note":"desde principal","set_category":"11"}', None, False),
    ("05", "Montos chicos", 70, 1, "Montos chicos van a varios", None, None, "general", "or",
     '{"amount_between":[10000,100000]}', '{"set_category":"9"}', None, False),
    ("06", "Cincuenta mil", 70, 1, None, None, None, "general", "or",
     '{"amount_equals":50000}', '{"add_note":"cincuenta"}', None, False),
    ("07", "Nunca", 60, 1, None, None, None, "general", "or",
     '{"amount_equals":null}', '{"add_note":"nunca"}', None, False),
    ("08", "Sin categoria", 40, 3, None, None, None, "general", "or",
     '{"source":["nequi_sms","sms"],"category":"food"}', '{"set_category":null,"auto_reconcile":true}', None, False),
    ("09", "Todas", 30, 1, None, None, None, "general", "and",
     '{"description_contains":[]}', '{"add_note":"todas"}', None, False),
    ("10", "Ninguna", 30, 1, None, None, None, "general", "or",
     '{"description_contains":[]}', '{"set_type":"income"}', None, False),
    ("11", "Claves raras", 20, 5, "Transferencias propias", None, "@U", "general", "or",
     '{"contains_text":["x"]}', '{"set_category":"13","link_account":"@U"}', None, False),
    ("12", "Apagada", 10, 0, None, None, None, "general", "or", '{}', '{"set_type":"income"}', None, False),
    ("13", "Borrada", 10, 1, None, None, None, "general", "or", '{}', '{"set_type":"income"}', None, True),
    ("14", "Bancolombia cuenta", 100, 2, None, None, None, "account_detection", "and",
     '{"raw_text_contains":["bancolombia","compraste"]}', '{"set_account":"@U"}', None, False),
    ("15", "Nequi sin cuenta", 90, 2, None, None, None, "account_detection", "or",
     '{"raw_text_contains":["nequi"]}', '{}', None, False),
    ("16", "Nequi o efectivo", 80, 1, None, None, None, "account_detection", "or",
     '{"raw_text_contains":["nequi","efectivo"]}', '{"set_account":"@U"}', None, False),
    ("17", "Ahorro propio", 200, 1, "Es mi ahorro", "@P", "@U", "transfer", "or",
     '{"raw_text_contains":["transferiste"]}', '{}', None, False),
    ("18", "Destino roto", 190, 1, None, "@Q", None, "transfer", "or",
     '{"raw_text_contains":["nadie"]}', '{"link_to_account":"@U"}', None, False),
]

RULE_COLUMNS = [
    "suffix", "name", "priority", "active_mod", "prompt_text", "match_phone",
    "transfer_to_account_id", "rule_type", "condition_logic", "conditions", "actions",
    "ai_prompt", "is_gone",
]

SETTINGS = [
    ("free_ai_parses_limit", "15"), ("free_transactions_limit", "50"), ("free_accounts_limit", "4"),
    ("free_automations_limit", "5"), ("free_categories_limit", "15"),
    ("support_email", '"help@example.org"'),
]


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(spark: SparkSession, sf_dir: str, view: str, busy: bool = False) -> DataFrame:
    """One ledger table; ``busy`` spreads its main scan for work that is heavy per row."""
    tables = {t: raw(spark, sf_dir, t) for t in SOURCES[view]}
    main = SOURCES[view][0]
    if busy:
        tables[main] = spread(tables[main])
    return stage_from(spark, view, **tables)


def stage_from(spark: SparkSession, view: str, **tables: DataFrame) -> DataFrame:
    """One ledger table from given frames, streaming ones included."""
    staged = spark.sql(STAGING[view], **tables)
    if view == "message":
        staged = once(staged, {"text": F.col("text"), "body": F.col("body")})
    return staged


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETTINGS, "key string, value string")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule templates, unrolled for every owner of an account."""
    def value(x):
        return F.lit(x) if x is not None else F.lit(None).cast("string")

    entries = F.array(
        *[F.struct(*[value(x).alias(c) for c, x in zip(RULE_COLUMNS, t)]) for t in RULE_TEMPLATES]
    )
    users = raw(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("user_id"))
    user = F.col("user_id").cast("string")
    phone = F.concat(F.lit("31"), F.lpad(user, 8, "0"))
    other = F.concat(F.lit("31"), F.lpad((F.col("user_id") + 25).cast("string"), 8, "0"))

    def own(column: str):
        text = F.replace(F.col(column), F.lit("@U"), user)
        return F.replace(F.replace(text, F.lit("@P"), phone), F.lit("@Q"), other).alias(column)

    mod = F.col("active_mod")
    return (
        users.distinct()
        .withColumn("t", F.explode(entries))
        .select("user_id", "t.*")
        .select(
            F.concat(user, F.lit("-"), "suffix").alias("rule_id"),
            "user_id",
            "name",
            F.when(mod == 0, F.lit(False)).otherwise(F.pmod("user_id", F.greatest(mod, F.lit(1))) == 0).alias("is_active"),
            "priority",
            "prompt_text",
            own("match_phone"),
            own("transfer_to_account_id"),
            "rule_type",
            "condition_logic",
            own("conditions"),
            own("actions"),
            "ai_prompt",
            F.when(F.col("is_gone"), F.lit("2024-01-01").cast("date")).alias("deleted_at"),
        )
    )


# (rule suffix, conditions) of rules that must be refused
MISTAKES = [
    ("91", '{"description_contains":"uber"}'), ("92", "not json"), ("93", '{"description_regex":"["}'),
    ("94", '{"amount_between":"x"}'), ("95", '{"source":["api",null]}'),
]


def rules_with_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and for every owner some that would fit everything or end the job."""
    good = rules(spark, sf_dir)
    entries = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in MISTAKES])
    pattern = good.filter(F.endswith("rule_id", F.lit("-01"))).withColumn("m", F.explode(entries))
    bad = pattern.withColumns({"rule_id": F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("m.s")), "conditions": F.col("m.c")})
    return good.unionByName(bad.drop("m"))


def slug_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default category tree provisioned for every owner of an account."""
    users = raw(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("user_id"))
    provisioned = provision_categories(users, default_template(spark))
    return provisioned.withColumns(
        {"is_active": F.lit(True), "deleted_at": F.lit(None).cast("date")}
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key per customer; every eleventh is switched off."""
    return raw(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("user_id"),
        F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("key_hash"),
        (F.col("c_custkey") % 11 != 0).alias("is_active"),
    )


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order, under its customer's key."""
    return raw(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("key-"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 20).cast("string")).alias("api_key"),
        F.col("o_orderdate").alias("received_at"),
    )
