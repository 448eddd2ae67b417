"""Resolution, transfers, duplicates, posting and table changes on small literal tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywell.operators import categories, dedup, mutate, posting, quality, resolve, transfers
from tallywell.schemas import RULE
from tallywell.sources import messages

ACCOUNT = ("account_id string, user_id bigint, name string, type string, institution string, last_four string, "
           "balance decimal(15,2), is_active boolean, deleted_at date")


def account(i, institution, four, kind, name="A", user=1, balance="100", active=True, deleted=None):
    return (i, user, name, kind, institution, four, Decimal(balance) if balance else None, active, deleted)


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([
        account("1", "bancolombia", "2651", "savings", "b"), account("2", "bancolombia", "2651", "checking", "c"),
        account("3", "bancolombia", "7799", "checking", "a"), account("4", "cash", None, "cash", "z", balance=None),
        account("5", "cash", None, "cash", "y", active=False), account("6", "nequi", None, "savings", "n", user=2),
        account("7", "bancolombia", "0000", "credit", "0", deleted=dt.date(2024, 1, 1)),
    ], ACCOUNT)


def probes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, user_id bigint, bank string, last_four string, account_type string, channel string")


def test_cascade(spark, accounts, monkeypatch):
    rows = probes(spark, [(1, "bancolombia", "2651", "savings", "api"), (1, "bancolombia", "2651", "credit", "api"),
                          (1, "bancolombia", None, "savings", "api"), (1, "bancolombia", None, None, "api"),
                          (1, "bancolombia", "9999", "checking", "api"), (1, "x", None, None, "api"), (2, "bancolombia", None, None, "api")])
    want = [("1", 1), ("1", 2), ("1", 3), ("3", 4), ("3", 3), (None, None), (None, None)]

    def got():
        found = resolve.resolve_accounts(rows, accounts)
        return [(r.cascade_account_id, r.cascade_tier) for r in found.orderBy("i").collect()]

    assert got() == want
    monkeypatch.setattr(resolve, "is_small", lambda df, rows=0: False)
    assert got() == want


def test_fallback_by_channel(spark, accounts):
    rows = probes(spark, [(1, "x", None, None, c) for c in ("api", "chat", "email", "parse")] + [(2, "x", None, None, "api"), (2, "nequi", None, None, "email")])
    found = resolve.with_fallback(resolve.resolve_accounts(rows, accounts), accounts)
    assert [r.account_id for r in found.orderBy("i").collect()] == ["4", "4", None, "4", None, "6"]
    hinted = resolve.resolve_accounts(rows, accounts).withColumn("detected_account_id", F.lit("9"))
    assert [r.account_id for r in resolve.with_fallback(hinted, accounts).orderBy("i").collect()] == ["9", "9", None, "9", "9", "6"]


def test_balance_lookup(spark, accounts):
    asked = spark.createDataFrame([("1", 1), ("4", 1), ("1", 2), ("x", 1)], "account_id string, user_id bigint")
    got = {(r.account_id, r.user_id): r.balance for r in resolve.balance_lookup(asked, accounts).collect()}
    assert got == {("1", 1): 100, ("4", 1): 0, ("1", 2): None, ("x", 1): None}


def legs(spark, text, rules, category="other"):
    from tallywell.functions import transfer

    rows = spark.createDataFrame([(7, 1, text, category, "cat-0", "acc-source", Decimal(100000), "algo", "expense", None)],
                                 "message_id bigint, user_id bigint, text string, category string, category_id string, account_id string, "
                                 "amount decimal(15,2), description string, type string, notes string")
    t = F.col("text")
    rows = rows.withColumns({"phone": transfer.phone(t), "origin_account": transfer.origin_account(t), "is_transfer": transfer.is_transfer(t)})
    owned = spark.createDataFrame([("cat-missing", 1, "M", "missing", True, None), ("cat-t", 1, "T", "transfer", True, None)],
                                  "category_id string, user_id bigint, name string, slug string, is_active boolean, deleted_at date")
    return transfers.split_transfers(rows, spark.createDataFrame(rules, RULE), owned).orderBy("leg").collect()


def phone_rule(rule_id, phone, target, priority=1):
    return (rule_id, 1, "Nequi", True, priority, None, phone, target, "transfer", "or", "{}", "{}", None, None)


def test_transfer_split(spark):
    plain = legs(spark, "Compraste en almacen", [phone_rule("a", "3104633357", "acc-dest")])
    assert [(r.type, r.category_id, r.notes) for r in plain] == [("expense", "cat-0", None)]
    no_phone = legs(spark, "Transferiste plata", [phone_rule("a", "3104633357", "acc-dest")])
    assert [(r.category_id, r.notes) for r in no_phone] == [("cat-missing", "Transfer - no matching phone found")]
    text = "Transferiste a *3104633357 desde tu cuenta 2651"
    no_rule = legs(spark, text, [phone_rule("a", "3000000000", "acc-dest")])
    assert [(r.type, r.notes) for r in no_rule] == [("expense", "Transfer to 3104633357 - no matching rule")]
    pair = legs(spark, text, [phone_rule("b", "3104633357", "acc-dest"), phone_rule("a", "3104633357", "acc-low", 0)])
    assert [(r.id, r.type, r.account_id, r.transfer_to_account_id, r.category_id) for r in pair] == [
        ("7-0", "transfer", "acc-source", "acc-dest", "cat-t"), ("7-1", "transfer", "acc-dest", None, "cat-t")]
    assert pair[0].transfer_id == pair[1].transfer_id and pair[0].description == "Transfer to Nequi"
    assert pair[1].description == "Transfer from algo" and pair[1].notes == "Internal transfer from account ending in 2651"
    by_category = legs(spark, "Algo raro", [phone_rule("a", "3104633357", "x")], category="transfer")
    assert by_category[0].category_id == "cat-missing"


LEDGER = ("id string, user_id bigint, type string, account_id string, transfer_to_account_id string, amount decimal(15,2), "
          "created_at timestamp_ntz, date date")


def test_effects_and_balances(spark, accounts):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", 1, "expense", "1", None, Decimal(30), day, day.date()), ("b", 1, "income", "1", None, Decimal(50), day, day.date()),
            ("c", 1, "transfer", "1", "4", Decimal(20), day + dt.timedelta(1), day.date()), ("d", 1, "transfer", "4", None, Decimal(20), day, day.date())]
    ledger = spark.createDataFrame(rows, LEDGER)
    effects = [(r.id, r.effect_account_id, int(r.delta)) for r in posting.balance_effects(ledger).collect()]
    assert sorted(effects) == [("a", "1", -30), ("b", "1", 50), ("c", "1", -20), ("c", "4", 20)]
    after = {r.account_id: r.new_balance for r in posting.apply_balances(accounts, ledger).collect()}
    assert after["1"] == 100 and after["4"] == 20 and after["2"] == 100
    run = posting.running_balance(ledger, accounts, ["created_at", "id"])
    assert sorted((r.effect_account_id, r.id, int(r.balance_after)) for r in run.collect()) == [("1", "a", 70), ("1", "b", 120), ("1", "c", 100), ("4", "c", 20)]


def test_duplicates_against_all_pairs(spark, monkeypatch):
    draw, t0 = random.Random(5), dt.datetime(2024, 1, 1)

    def row(i):
        return (i, f"m{i}", draw.choice([1, 2]), draw.choice(["api", "sms"]), draw.choice("xyz"), dt.date(2024, 1, draw.choice([1, 2])),
                Decimal(draw.choice([5, 6])), draw.choice(["a", "b", None]), t0 + dt.timedelta(seconds=draw.randrange(30)),
                draw.choice([None, None, None, t0]), draw.choice(["a", "b"]))

    schema = ("message_id bigint, id string, user_id bigint, source string, raw_text string, date date, amount decimal(15,2), account_id string, "
              "created_at timestamp_ntz, deleted_at timestamp_ntz, before_rules string")
    rows = [row(i) for i in range(80)]
    df = spark.createDataFrame(rows, schema)

    def first(of, same):
        older = [s for s in rows if s[9] is None and (s[8], s[0]) < (of[8], of[0]) and same(s)]
        return min(older, key=lambda s: (s[8], s[0]))[1] if older else None

    want = {}
    for n in rows:
        exact = first(n, lambda s: s[2:5] == n[2:5])
        near = first(n, lambda s: (s[2], s[5], s[6], s[7]) == (n[2], n[5], n[6], n[10]))
        want[n[1]] = exact or near
    got = {r.id: (r.duplicate_of, r.duplicate_status) for r in dedup.flag_duplicates(df, df, "before_rules").collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all((s == "pending_review") == (d is not None) for d, s in got.values())


def test_category_upsert_keeps_names_and_drops_orphans(spark):
    old = spark.createDataFrame([("p", 1, "Mine", "food", "expense", None, None, False)],
                                "category_id string, user_id bigint, name string, slug string, type string, spending_nature string, parent_id string, is_default boolean")
    old = old.withColumn("translations", F.create_map(F.lit("en"), F.lit("Old")))
    new = spark.createDataFrame([(1, "food", "Food", "expense", "need", None), (1, "bar", "Bar", "expense", "want", "food"),
                                 (1, "car", "Car", "expense", "want", None), (1, "fuel", "Fuel", "expense", "must", "car"), (1, "x", "X", "expense", "must", "gone")],
                                "user_id bigint, slug string, name string, type string, spending_nature string, parent_slug string")
    new = new.withColumn("translations", F.create_map(F.lit("en"), F.col("name")))
    merged, lost = categories.upsert_categories(old, new)
    rows = {r.slug: r for r in merged.collect()}
    assert rows["food"].translations == {"en": "Food"}  # refreshed, while the name stays
    assert rows["food"].name == "Mine" and rows["food"].spending_nature == "need" and rows["food"].is_default
    assert rows["bar"].parent_id == "p" and rows["fuel"].parent_id == rows["car"].category_id
    assert set(rows) == {"food", "bar", "car", "fuel"} and [r.slug for r in lost.collect()] == ["x"]


def test_default_tree(spark):
    users = spark.createDataFrame([(1,), (2,), (1,)], "user_id bigint")
    made = categories.provision_categories(users, categories.default_template(spark))
    assert made.count() == 2 * 86 and made.filter("parent_id IS NULL").count() == 2 * 12
    ids = {r.category_id for r in made.collect()}
    assert all(r.parent_id in ids for r in made.filter("parent_id IS NOT NULL").collect())


def test_default_categories_are_not_deleted(spark):
    held = spark.createDataFrame([("a", None, False), ("b", "a", True), ("c", None, True), ("d", None, False)], "category_id string, parent_id string, is_default boolean")
    ledger = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "id string, category_id string")
    left, unlinked, refused = mutate.delete_categories(held, ledger, spark.createDataFrame([("a",), ("c",)], "category_id string"))
    assert sorted(r.category_id for r in left.collect()) == ["c", "d"]
    assert {r.id: r.category_id for r in unlinked.collect()} == {"1": None, "2": None, "3": "c", "4": None}
    assert [r.category_id for r in refused.collect()] == ["c"]


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([("1", None), ("2", 101), ("3", 50)], "id string, confidence int")
    checks = {"confidence 0 to 100": ("confidence", F.col("confidence").between(0, 100))}
    assert [tuple(r) for r in quality.violations(df, "t", "id", checks).collect()] == [("t", "2", "confidence 0 to 100", "101")]


def test_bulk_lists(spark):
    raw = ['["a","b"]', "uno\n \n dos \n", '{"messages":["x","y"]}', '{"0":"p","1":"q"}', "[]", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {}
    for r in messages.bulk_messages(df, "raw").orderBy("i", "position").collect():
        got.setdefault(r.i, []).append(r.text)
    assert got == {0: ["a", "b"], 1: ["uno", " dos "], 2: ["x", "y"], 3: ["p", "q"]}


def test_channel_readers_agree_with_the_mixed_one(spark):
    shape = "message_id bigint, channel string, user_id bigint, text string, body string, subject string, source string, received_at timestamp_ntz"
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "api", 1, "x", None, None, None, now), (2, "api", 1, "", None, None, "sms", now),
                                  (3, "email", 1, "t", "Bancolombia: pagaste $5 en X", None, None, now), (4, "email", 1, None, None, "promo", None, now),
                                  (5, "email", 1, None, "", "bancolombia", None, now), (6, "chat", 1, "/gasto", None, None, None, now)], shape)
    mixed = {r.message_id: (r.text, r.problem) for r in messages.by_channel(rows).collect()}
    apart = messages.union_channels(messages.api_messages(rows.filter("channel = 'api'")), messages.email_messages(rows.filter("channel = 'email'")),
                                    messages.chat_messages(rows.filter("channel = 'chat'")))
    assert {r.message_id: (r.text, r.problem) for r in apart.collect()} == mixed
    assert mixed == {1: ("x", None), 2: ("", "Missing text"), 3: ("Bancolombia: pagaste $5 en X", None), 4: (None, "not_bancolombia"),
                     5: (None, "no_text_extracted"), 6: ("", "Missing text")}


def test_settings_fall_back(spark):
    rows = spark.createDataFrame([("free_ai_parses_limit", "20"), ("free_accounts_limit", "x"), ("support_email", '"a"')], "key string, value string")
    row = resolve.settings_row(rows).head()
    assert (row.free_ai_parses_limit, row.free_transactions_limit, row.free_accounts_limit) == (20, 50, None)
    one = spark.range(1).select(resolve.setting(rows, "free_ai_parses_limit", 15), resolve.setting(rows, "free_transactions_limit", 50))
    assert tuple(one.head()) == (20, 50)


def test_balance_edits(spark, accounts):
    targets = spark.createDataFrame([("1", Decimal("130")), ("2", Decimal("100")), ("4", Decimal("-5"))], "account_id string, target_balance decimal(15,2)")
    moves = {r.account_id: (int(r.amount), r.type) for r in mutate.adjust_balances(accounts, targets).collect()}
    assert moves == {"1": (30, "income"), "4": (5, "expense")}
    direct = {r.account_id: r.balance for r in mutate.set_balances(accounts, targets).collect()}
    assert direct["1"] == 130 and direct["4"] == -5 and direct["3"] == 100


def test_column_defaults_and_stamp(spark):
    rows = spark.createDataFrame([("1", None, None, None), ("2", "USD", Decimal(3), False)], "id string, currency string, balance decimal(15,2), is_active boolean")
    got = [tuple(r) for r in mutate.with_account_defaults(rows).orderBy("id").collect()]
    assert got == [("1", "COP", 0, True), ("2", "USD", 3, False)]


def test_limits_of_batches_are_cumulative_and_spare_pro(spark):
    from tallywell.operators import usage

    held = spark.createDataFrame([(1,)] * 3 + [(2,)] * 20, "user_id bigint")
    batch = spark.createDataFrame([(u, b) for u in (1, 2, 3) for b, n in (("a", 4), ("b", 4), ("c", 1)) for _ in range(n)], "user_id bigint, batch string")
    subs = spark.createDataFrame([(2, "pro", "active"), (3, "pro", "canceled")], "user_id bigint, plan string, status string")
    rows = usage.enforce_limit(held, batch, "batch", F.lit(8), subs).collect()
    assert {(r.user_id, r.batch): (r.held, r.wanted, r.accepted) for r in rows} == {
        (1, "a"): (3, 4, True), (1, "b"): (7, 4, False), (1, "c"): (7, 1, True),
        (2, "a"): (20, 4, True), (2, "b"): (24, 4, True), (2, "c"): (28, 1, True),
        (3, "a"): (0, 4, True), (3, "b"): (4, 4, True), (3, "c"): (8, 1, False),
    }


def test_current_month_and_pro_in_usage(spark):
    import datetime as dt

    from tallywell.operators import usage

    rows = spark.createDataFrame([(u, dt.datetime(2024, m, 2)) for u in (1, 2) for m in (1, 2) for _ in range(3)], "user_id bigint, at timestamp_ntz")
    now = F.lit("2024-02-20 00:00:00").cast("timestamp_ntz")
    counts = usage.resource_counts(ai_parses=usage.in_month(rows, "at", now))
    settings = spark.createDataFrame([("free_ai_parses_limit", "2")], "key string, value string")
    subs = spark.createDataFrame([(2, "pro", "active")], "user_id bigint, plan string, status string")
    out = {r.user_id: (r.used, r.limit, r.over_limit) for r in usage.usage_vs_limits(counts, settings, subs).collect()}
    assert out == {1: (3, 2, True), 2: (3, -1, False)}


def test_categories_held_or_brought_before_are_not_new(spark):
    from tallywell.operators import usage

    held = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "user_id long, name string")
    offers = [(1, "1", "a"), (1, "1", "b"), (1, "1", "c"), (1, "2", "d"), (1, "2", "e"), (1, "3", "c"), (1, "3", "d"), (1, "4", None), (2, "1", "a"), (2, "1", "x"), (2, "2", "x"), (3, "1", "y"), (3, "1", "y")]
    offered = spark.createDataFrame(offers, "user_id long, import_id string, name string")
    plans = spark.createDataFrame([(2, "pro", "active")], "user_id long, plan string, status string")
    rows = usage.enforce_new(held, offered, "import_id", "name", F.lit(4), plans).collect()
    assert {(r.user_id, r.import_id): (r.held, r.wanted, r.accepted) for r in rows} == {
        (1, "1"): (2, 1, True), (1, "2"): (3, 2, False), (1, "3"): (3, 1, True), (1, "4"): (4, 0, True),
        (2, "1"): (1, 1, True), (2, "2"): (2, 0, True), (3, "1"): (0, 1, True),
    }


def _folded(own, offers, cap, pro):
    """One user's batches in order, one at a time: (held before, wanted, accepted) of each."""
    at, own, out = own[0], set(own[1]), {}
    for batch in sorted(offers, key=lambda b: (b is not None, b)):
        brings = offers[batch]
        new = brings if isinstance(brings, int) else len(set(brings) - own - {None})
        fits = pro or at + new <= cap
        out[batch] = (at, new, fits)
        if fits:
            at += new
            own |= set() if isinstance(brings, int) else set(brings)
    return out


@pytest.mark.parametrize("head_sets", [2, 2_000])
def test_limits_equal_one_batch_at_a_time(spark, monkeypatch, head_sets):
    """Random users, with missing users, batches and items, against a plain walk."""
    import random

    from tallywell.operators import usage

    monkeypatch.setattr(usage, "HEAD_SETS", head_sets)
    rng, items = random.Random(7), "abcdefghij"
    users = [None, *range(30)]
    held = {u: [rng.choice([*items, None]) for _ in range(rng.randrange(8))] for u in users}
    offers = {
        u: {b: [rng.choice([*items[: rng.randrange(2, 11)], None]) for _ in range(rng.randrange(1, 6))] for b in rng.sample([None, *range(12)], 9)}
        for u in users
    }
    have = spark.createDataFrame([(u, i) for u in users for i in held[u]], "user_id long, name string")
    brought = spark.createDataFrame([(u, b, i) for u in users for b in offers[u] for i in offers[u][b]], "user_id long, import_id long, name string")
    plans = spark.createDataFrame([(u, "pro", "active") for u in (1, 2)], "user_id long, plan string, status string")
    got = {(r.user_id, r.import_id): (r.held, r.wanted, r.accepted) for r in usage.enforce_new(have, brought, "import_id", "name", F.lit(8), plans).collect()}
    want = {(u, b): v for u in users for b, v in _folded((len(held[u]), held[u]), offers[u], 8, u in (1, 2)).items()}
    assert got == want
    counts = {u: {b: len(v) for b, v in offers[u].items()} for u in users}
    got = {(r.user_id, r.import_id): (r.held, r.wanted, r.accepted) for r in usage.enforce_limit(have, brought, "import_id", F.lit(14), plans).collect()}
    assert got == {(u, b): v for u in users for b, v in _folded((len(held[u]), ()), counts[u], 14, u in (1, 2)).items()}


def test_batches_of_one_user_are_many_tasks(spark):
    """100,000 batches of one user: what the limit lets in is picked in slices, and the rest spreads over ranges."""
    from tallywell.operators import usage

    batch = spark.range(100_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("batch"), F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 3)))
    none = spark.createDataFrame([], "user_id long, plan string, status string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join small partitions
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = usage.enforce_limit(batch.limit(0), batch, "batch", F.lit(50), none)
        parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [r for r in out.collect() if r.accepted]
    assert sum(r["count"] for r in parts) == 100_000 and max(r["count"] for r in parts) < 40_000
    assert sum(r.wanted for r in rows) == 50 and [r.batch for r in sorted(rows, key=lambda r: r.batch)][:3] == [0, 1, 2]


def test_every_resource_is_enforced(spark):
    from tallywell.catalog import QUERIES

    rows = QUERIES["resource_limits"](spark, "/root/testdata/sf0.001").collect()
    assert {r.resource for r in rows} == {"transactions", "categories", "accounts", "automations"}
    loads = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sum(r.wanted for r in rows if r.resource == "transactions") == loads


def test_missing_texts_of_any_message_are_reported(spark, monkeypatch):
    from tallywell import catalog

    staged = catalog.st.stage

    def with_gap(spark, sf, view, **options):
        rows = staged(spark, sf, view, **options)
        return rows.withColumn("text", F.when(F.col("message_id") != 8, F.col("text"))) if view == "message" else rows

    monkeypatch.setattr(catalog.st, "stage", with_gap)
    found = catalog.QUERIES["constraint_violations"](spark, "/root/testdata/sf0.001").filter("table_name = 'skipped_messages'")
    assert "8" in {r.row_id for r in found.collect()}
