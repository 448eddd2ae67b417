"""Every registered query: (spark, folder of test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import eventtime, present, text, transfer
from tallywell.operators import (
    categories,
    dedup,
    mutate,
    parse,
    posting,
    quality,
    reports,
    resolve,
    rules,
    sinks,
    statement,
    transfers,
    usage,
)
from tallywell.plans import flows
from tallywell.session import materialise, shared_dir
from tallywell.sources import messages as src
from tallywell.sources import staging as st
from tallywell.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def shaped(spark, sf):
    return src.by_channel(st.stage(spark, sf, "message", busy=True))


def readable(spark, sf):
    return shaped(spark, sf).filter(F.col("problem").isNull())


def parsed(spark, sf, only=None):
    return parse.parse_messages(readable(spark, sf), only)


def dated(spark, sf, only=None):
    return parse.with_event_time(parsed(spark, sf, only))


def run_ts():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def ledger_now():
    """A moment in the ledger's last months; the messages are of another year."""
    return F.lit("1998-07-15 00:00:00").cast("timestamp_ntz")


def message_now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


# -- scope, owners, settings -------------------------------------------------------------
@query
def live_accounts(spark, sf):
    live = resolve.live(st.stage(spark, sf, "account"))
    return live.select("account_id", "user_id", "name", "type", "balance").orderBy("name", "account_id")


@query
def owner_scope(spark, sf):
    ledger = resolve.not_deleted(st.stage(spark, sf, "txn"))
    own = resolve.live(st.stage(spark, sf, "account")).select("user_id", "account_id", "name")
    rows = resolve.lookup(ledger, own, ["user_id", "account_id"], "inner")
    return rows.select("id", "user_id", "account_id", F.col("name").alias("account_name"))


@query
def owner_by_key(spark, sf):
    owned = resolve.attribute_owner(st.api_requests(spark, sf), st.api_keys(spark, sf))
    return owned.select("request_id", "user_id", "key_hash")


@query
def last_key_use(spark, sf):
    return resolve.last_key_use(
        resolve.attribute_owner(st.api_requests(spark, sf), st.api_keys(spark, sf))
    )


# -- parsing -----------------------------------------------------------------------------
@query
def channel_union(spark, sf):
    return shaped(spark, sf).select("message_id", "channel", "text", "source", "problem")


@query
def email_extract(spark, sf):
    emails = st.stage(spark, sf, "message").filter(F.col("channel") == "email")
    return src.email_messages(emails).select("message_id", "text", "source", "problem")


@query
def bulk_explode(spark, sf):
    """Bulk lists: a user's day of texts as JSON array, object or plain lines by turns."""
    texts = readable(spark, sf).select(
        "message_id", F.to_json(F.array("text", F.lit(" ok "))).alias("listed"),
        F.to_json(F.struct(F.array("text", "channel").alias("messages"))).alias("wrapped"),
        F.to_json(F.struct(F.col("channel").alias("a"), F.col("text").alias("b"))).alias("object"),
        F.concat(F.col("text"), F.lit("\r\n\t\r\nfin")).alias("lines"),
    )
    kind = F.col("message_id") % 4
    raw = (
        F.when(kind == 0, F.col("listed")).when(kind == 1, F.col("wrapped"))
        .when(kind == 2, F.col("object")).otherwise(F.col("lines"))
    )
    rows = src.bulk_messages(texts.select("message_id", raw.alias("raw")), "raw")
    return rows.select("message_id", F.col("position").cast("bigint").alias("position"), "text", "source")


@query
def parse_amount_source(spark, sf):
    return parsed(spark, sf).select("message_id", "amount", "parsed_source", "description")


@query
def parse_bank_fields(spark, sf):
    fields = ["bank", "payment_type", "account_type", "last_four", "confidence"]
    return parsed(spark, sf, fields).select("message_id", *fields)


@query
def parse_category(spark, sf):
    return parsed(spark, sf).select("message_id", "description", "category")


@query
def parse_dates(spark, sf):
    return parsed(spark, sf).select("message_id", "original_date", "original_time")


@query
def classify_skips(spark, sf):
    return (
        parse.skipped(parsed(spark, sf))
        .groupBy("channel", "reason")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


@query
def validate_parsed(spark, sf):
    txn = st.stage(spark, sf, "txn")
    k = F.col("seq")
    body = F.to_json(
        F.struct(
            F.when(k % 5 != 0, F.col("amount")).alias("amount"),
            F.when(k % 7 == 0, F.lit("  ")).otherwise(F.col("description")).alias("description"),
            F.when(k % 11 == 0, F.lit("")).otherwise(F.col("source")).alias("category"),
            F.when(k % 3 == 0, k % 2 == 0).alias("is_transaction"),
        )
    )
    document = F.when(k % 13 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        k % 17 == 0, F.lit("no json")
    ).otherwise(body)
    read = parse.read_parsed_json(txn.select("id", document.alias("document")), "document")
    checked = parse.validate_parsed(read)
    return checked.select("id", "amount", "description", "bad_json", "is_transaction", "reject_reason")


@query
def validate_values(spark, sf):
    txn, k = st.stage(spark, sf, "txn"), F.col("seq")
    iso = F.col("date").cast("string")
    values = txn.select(
        "id",
        F.when(k % 4 == 0, eventtime.to_slashed(iso)).when(k % 4 == 1, F.replace(iso, F.lit("-0"), F.lit("-4"))).otherwise(iso).alias("day"),
        F.when(k % 5 == 0, F.replace(F.col("time"), F.lit("0"), F.lit("7"))).otherwise(F.col("time")).alias("clock"),
        F.when(k % 6 == 0, -F.col("amount")).when(k % 6 == 1, F.lit(0)).otherwise(F.col("amount")).cast("decimal(15,2)").alias("amount"),
        F.concat(F.replace(F.col("description"), F.lit(" "), F.when(k % 3 == 0, " ").otherwise(".")), F.when(k % 7 == 0, "").otherwise("@mail.co")).alias("mail"),
    )
    return values.select(
        "id", present.is_valid_date(F.col("day")).alias("date_ok"), present.is_valid_time(F.col("clock")).alias("time_ok"),
        present.is_valid_amount(F.col("amount")).alias("amount_ok"), present.is_valid_email(F.col("mail")).alias("mail_ok"),
    )


def stated_days(spark, sf):
    """Stated dates and times in every form the fixers know, from the ledger's own days."""
    k, d, t = F.col("seq"), F.col("date"), F.col("time")
    day, month, year = F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string")
    year = F.when(k % 9 == 0, "1999").otherwise(F.concat(F.lit("20"), F.substring(year, 3, 2)))
    form = k % 8
    stated = (
        F.when(form == 0, F.concat_ws("/", text.pad2(day), text.pad2(month), year))
        .when(form == 1, F.concat_ws("/", text.pad2(month), text.pad2(day), year))
        .when(form == 2, F.concat_ws("/", day, month, year))
        .when(form == 3, F.concat_ws("/", month, day, year))
        .when(form == 4, F.concat_ws("-", year, text.pad2(month), text.pad2(day)))
        .when(form == 5, F.concat(F.lit(" 1/45/"), year, F.lit(" ")))
        .when(form == 6, F.concat_ws("/", day, month, F.substring(year, 3, 2)))
    )
    clock = (
        F.when(k % 6 == 0, F.regexp_replace(t, "^0", ""))
        .when(k % 6 == 1, F.concat(F.lit(" "), t))
        .when(k % 6 == 2, F.replace(t, F.lit("1"), F.lit("7")))
        .when(k % 6 == 3, F.concat(t, F.lit(":00")))
        .when(k % 6 == 4, t)
    )
    return st.stage(spark, sf, "txn").select("id", stated.alias("stated_date"), clock.alias("stated_time"))


@query
def event_time_fix(spark, sf):
    fixed = eventtime.fix_date(F.col("stated_date"))
    return stated_days(spark, sf).select(
        "id", fixed.alias("fixed_date"), eventtime.to_iso(fixed).alias("iso_date"),
        eventtime.fix_time(F.col("stated_time")).alias("fixed_time"),
    )


@query
def event_time_choose(spark, sf):
    return dated(spark, sf).select("message_id", "date", "time")


@query
def parse_preview(spark, sf):
    """Parse-only requests: fields, resolved account and category, nothing posted."""
    fields = ["amount", "original_date", "original_time", "category", "bank", "last_four", "account_type", "is_transaction"]
    preview = parse.with_preview_time(parse.transactions_only(parsed(spark, sf, fields)))
    preview = preview.select("message_id", "user_id", *fields[:-1]).withColumn("channel", F.lit("parse"))
    accounts = st.stage(spark, sf, "account")
    placed = resolve.with_fallback(resolve.resolve_accounts(preview, accounts), accounts)
    known = resolve.resolve_categories(placed, st.slug_categories(spark, sf))
    return known.select(
        "message_id", "amount", "original_date", "original_time", "account_id", "category_id"
    )


def previewed(spark, sf):
    return flows.preview(
        readable(spark, sf), st.stage(spark, sf, "account"), st.slug_categories(spark, sf), st.rules(spark, sf),
        st.stage(spark, sf, "usage_stored"), st.stage(spark, sf, "subscription"), st.settings(spark),
    )


@query
def preview_resolved(spark, sf):
    return previewed(spark, sf).previews.select(
        "message_id", "user_id", "parsed.amount", "parsed.category", "parsed.original_date", "resolved.account_id", "resolved.category_id"
    )


@query
def preview_denied(spark, sf):
    return previewed(spark, sf).denied


# -- transfers ---------------------------------------------------------------------------
@query
def transfer_extract(spark, sf):
    body = F.col("text")
    return readable(spark, sf).select(
        "message_id", transfer.phone(body).alias("phone"), transfer.origin_account(body).alias("origin_account"),
        transfer.is_transfer(body).alias("is_transfer"),
    )


def split_legs(spark, sf):
    rows = parse.transactions_only(dated(spark, sf)).withColumns(
        {
            "account_id": F.col("bank"),
            "category_id": F.col("category"),
            "type": F.lit("expense"),
            "notes": F.when(F.col("message_id") % 3 == 0, "nota"),
        }
    )
    return transfers.split_transfers(rows, st.rules(spark, sf), st.slug_categories(spark, sf))


@query
def transfer_split(spark, sf):
    return split_legs(spark, sf).select(
        "id", "message_id", F.col("leg").cast("bigint").alias("leg"), "type", "category_id", "account_id",
        "transfer_to_account_id", "transfer_id", "description", "notes", "amount",
    )


@query
def transfer_pairs(spark, sf):
    return transfers.transfer_pairs(split_legs(spark, sf))


# -- accounts ----------------------------------------------------------------------------
@query
def account_cascade(spark, sf):
    rows = parsed(spark, sf, ["bank", "last_four", "account_type"]).select("message_id", *resolve.ACCOUNT_PROBE)
    placed = resolve.resolve_accounts(rows, st.stage(spark, sf, "account"))
    return placed.select(
        "message_id", "user_id", "cascade_account_id", F.col("cascade_tier").cast("bigint").alias("cascade_tier")
    )


@query
def account_fallback(spark, sf):
    accounts = st.stage(spark, sf, "account")
    found = rules.detect_accounts(parsed(spark, sf, ["bank", "last_four", "account_type"]), st.rules(spark, sf))
    found = found.select("message_id", "channel", "detected_account_id", *resolve.ACCOUNT_PROBE)
    placed = resolve.with_fallback(resolve.resolve_accounts(found, accounts), accounts)
    return placed.select("message_id", "channel", "account_id")


@query
def account_detect(spark, sf):
    found = rules.detect_accounts(readable(spark, sf), st.rules(spark, sf))
    return found.select("message_id", "detection_rule_id", "detected_account_id")


@query
def accounts_without_rule(spark, sf):
    lacking = rules.accounts_without_rule(st.stage(spark, sf, "account"), st.rules(spark, sf))
    return lacking.select("account_id", "user_id", "name")


@query
def account_rules_gen(spark, sf):
    made = rules.account_rules(st.stage(spark, sf, "account"))
    return made.select("rule_id", "user_id", "name", "priority", "conditions", "actions")


@query
def balance_lookup(spark, sf):
    asked = st.stage(spark, sf, "txn").select(
        "id", F.when(F.col("seq") % 5 == 0, F.concat("account_id", F.lit("0"))).otherwise(F.col("account_id")).alias("account_id"),
        "user_id",
    )
    return resolve.balance_lookup(asked, st.stage(spark, sf, "account")).select("id", "account_id", "balance")


# -- categories --------------------------------------------------------------------------
@query
def category_lookup(spark, sf):
    known = parsed(spark, sf).withColumn("renamed", categories.current_slug(F.col("category")))
    owned = st.slug_categories(spark, sf)
    first = resolve.resolve_categories(known, owned)
    both = resolve.resolve_categories(first, owned, "renamed", "renamed_id")
    return both.select("message_id", "category", "category_id", "renamed", "renamed_id")


@query
def category_tree(spark, sf):
    tree = categories.category_tree(st.stage(spark, sf, "category"))
    return tree.select("category_id", "slug", "parent_slug", "parent_name")


@query
def categories_listed(spark, sf):
    held = st.stage(spark, sf, "category")
    shown, hidden = (reports.categories_by_visibility(held, a) for a in (True, False))
    return shown.unionByName(hidden).select("category_id", "user_id", "name", "is_active")


def offered_categories(spark, sf):
    """What a category upsert is offered: a template row per customer's nation and segment."""
    customer = st.raw(spark, sf, "customer")
    slug = F.lower(F.concat(F.lit("nation-"), (F.col("c_custkey") % 40).cast("string")))
    return customer.select(
        (F.col("c_nationkey") % 7).cast("bigint").alias("user_id"), slug.alias("slug"),
        F.concat(F.lit("New "), slug).alias("name"), F.lit("expense").alias("type"), F.lit("must").alias("spending_nature"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, "nation-3").otherwise("nowhere").alias("parent_slug"),
    ).groupBy("user_id", "slug").agg(*[F.min(c).alias(c) for c in ("name", "type", "spending_nature", "parent_slug")])


def upserted(spark, sf):
    held = st.stage(spark, sf, "category").withColumn("translations", F.when(F.col("is_default"), F.create_map(F.lit("en"), F.col("name"))))
    offered = offered_categories(spark, sf)
    names = F.create_map(F.lit("en"), F.col("name"), F.lit("es"), F.concat(F.lit("Es "), "slug"))
    return categories.upsert_categories(held, offered.withColumn("translations", names))


@query
def category_upsert(spark, sf):
    merged, _ = upserted(spark, sf)
    return merged.select(
        "category_id", "user_id", "slug", "name", "type", "spending_nature", "parent_id", "is_default", "outcome",
        F.try_element_at("translations", F.lit("en")).alias("en_name"), F.try_element_at("translations", F.lit("es")).alias("es_name"),
    )


@query
def category_upsert_orphans(spark, sf):
    return upserted(spark, sf)[1]


@query
def insert_ignored(spark, sf):
    held = st.stage(spark, sf, "category").select("user_id", "slug", "name")
    return categories.insert_ignore(held, offered_categories(spark, sf).select("user_id", "slug", "name"), ["user_id", "slug"])


@query
def default_provisioning(spark, sf):
    owned = st.slug_categories(spark, sf)
    return owned.select(
        "category_id", "user_id", "slug", "name", "type", "spending_nature", "parent_id", "is_default",
        F.try_element_at("translations", F.lit("en")).alias("en_name"),
    )


@query
def default_accounts(spark, sf):
    users = st.raw(spark, sf, "events").select("user_id")
    cash = categories.provision_accounts(users)
    plan = categories.provision_subscriptions(users)
    return cash.join(plan, "user_id").select("account_id", "user_id", "name", "type", "balance", "is_default", "plan", "status")


@query
def default_phone_rules(spark, sf):
    accounts = st.stage(spark, sf, "account")
    made = categories.default_phone_rules(accounts, st.slug_categories(spark, sf), "3104633357")
    return made.select("rule_id", "user_id", "priority", "match_phone", "transfer_to_account_id", "conditions", "actions")


@query
def slug_backfill(spark, sf):
    named = st.stage(spark, sf, "account").select("account_id", F.concat("name", F.lit(" Y Otra")).alias("name"), F.when(F.col("is_default"), F.lit("kept")).alias("slug"))
    return categories.backfill_slugs(named)


@query
def localised_names(spark, sf):
    held = st.stage(spark, sf, "category")
    names = F.when(F.col("is_default"), F.create_map(F.lit("en"), F.col("name"), F.lit("es"), F.concat(F.lit("El "), "name")))
    shown = categories.localise_names(held.withColumn("translations", names), "es")
    both = categories.localise_names(shown.withColumnRenamed("local_name", "es_name"), "pt")
    ledger = resolve.lookup(st.stage(spark, sf, "txn"), both.select("category_id", "es_name", F.col("local_name").alias("pt_name")), ["category_id"])
    return ledger.select("id", "es_name", "pt_name")


# -- rules -------------------------------------------------------------------------------
@query
def rule_match(spark, sf):
    return rules.match_rules(st.stage(spark, sf, "txn", busy=True), st.rules_with_mistakes(spark, sf)).select("id", "rule_id")


@query
def rules_refused(spark, sf):
    """Refused rules, with the ledger rows of their owners that they would have seen."""
    refused = rules.refused_rules(st.rules_with_mistakes(spark, sf))
    seen = st.stage(spark, sf, "txn").groupBy("user_id").agg(F.count("*").alias("rows_spared"))
    return refused.join(seen, "user_id", "left").select("rule_id", "refusal", F.coalesce("rows_spared", F.lit(0).cast("bigint")).alias("rows_spared"))


def ruled(spark, sf):
    return rules.apply_rules(st.stage(spark, sf, "txn", busy=True), st.rules_with_mistakes(spark, sf))


@query
def rule_apply(spark, sf):
    fired = F.array_join(F.transform("applied_rules", lambda a: a["rule_id"]), ",")
    return ruled(spark, sf).select(
        "id", "type", "category_id", "account_id", "transfer_to_account_id", "transfer_id", "notes",
        F.coalesce(fired, F.lit("")).alias("fired"),
    )


@query
def rule_apply_messages(spark, sf):
    """Rules over parsed messages, whose fields fit other conditions than the ledger's."""
    rows = parse.transactions_only(parsed(spark, sf)).withColumns(
        {
            "id": F.col("message_id").cast("string"), "type": F.lit("expense"), "category_id": F.col("category"),
            "account_id": F.col("bank"), "transfer_to_account_id": F.lit(None).cast("string"),
            "transfer_id": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "raw_text": F.col("text"),
        }
    )
    done = rules.apply_rules(rows, st.rules(spark, sf))
    fired = F.array_join(F.transform("applied_rules", lambda a: a["rule_id"]), ",")
    return done.select("id", "type", "category_id", "account_id", "notes", F.coalesce(fired, F.lit("")).alias("fired"))


@query
def override_flags(spark, sf):
    before = st.stage(spark, sf, "txn")
    flags = rules.override_flags(before, ruled(spark, sf))
    accounts = st.stage(spark, sf, "account").select("account_id", F.col("name").alias("account_name"))
    named = resolve.lookup(flags, accounts, ["account_id"], costly=True)
    held = st.stage(spark, sf, "category").select("category_id", F.col("name").alias("category_name"))
    return resolve.lookup(named, held, ["category_id"], costly=True).select(
        "id", "type_changed", "category_id_changed", "account_id_changed", "account_name", "category_name"
    )


@query
def applied_rule_audit(spark, sf):
    return reports.applied_rule_audit(ruled(spark, sf))


@query
def rule_digest(spark, sf):
    return rules.rule_digest(st.rules(spark, sf))


@query
def transfer_digest(spark, sf):
    return rules.transfer_digest(st.rules(spark, sf))


@query
def parse_context(spark, sf):
    found = rules.parse_context(readable(spark, sf), st.rules(spark, sf))
    return found.select("message_id", F.sha2("context", 256).alias("context_hash"), F.length("context").cast("bigint").alias("context_length"))


@query
def rule_defaults(spark, sf):
    """Generated rules with gaps, one JSON array per part."""
    part, k = st.raw(spark, sf, "part"), F.col("p_partkey")
    rule = F.to_json(
        F.struct(
            F.when(k % 2 == 0, F.col("p_name")).when(k % 4 == 1, F.lit("")).alias("name"),
            F.when(k % 3 == 0, k % 2 == 0).alias("is_active"),
            F.when(k % 5 != 0, (k % 3).cast("int")).alias("priority"),
            F.when(k % 7 == 0, "").when(k % 7 == 1, "transfer").alias("rule_type"),
            F.when(k % 2 == 1, "and").alias("condition_logic"),
            F.when(k % 4 == 0, F.struct(F.col("p_size").alias("amount_equals"))).alias("conditions"),
            F.when(k % 6 == 0, F.struct(F.col("p_brand").alias("set_category"))).alias("actions"),
        )
    )
    document = F.concat(F.when(k % 2 == 0, "```json\n").otherwise(""), F.lit("["), rule, F.lit(",{}]"), F.when(k % 2 == 0, "\n```").otherwise(""))
    return rules.normalise_generated(part.select("p_partkey", document.alias("document")), "document")


@query
def rules_listed(spark, sf):
    kept = reports.rules_by_kind(st.rules(spark, sf), active=True).unionByName(
        reports.rules_by_kind(st.rules(spark, sf), rule_type="account_detection", active=False)
    )
    return kept.select("rule_id", "rule_type", F.col("priority").cast("bigint").alias("priority"), "is_active")


# -- duplicates and the parse cache ------------------------------------------------------
def dup_rows(spark, sf, only=None):
    """Dated transactions, written once: duplicate search reads them from several sides.

    ``only`` names the parsed fields that are wanted beside those that make a row a dated transaction of its source.
    """
    if only is not None:
        only = ["is_transaction", "original_date", "original_time", "parsed_source", "bank", *only]
    rows = parse.transactions_only(dated(spark, sf, only)).filter(F.col("date").isNotNull())
    rows = rows.withColumns(
        {
            "id": F.col("message_id").cast("string"), "source": F.coalesce("source", "parsed_source"),
            "raw_text": F.col("text"), "created_at": F.col("received_at"), "account_id": F.col("bank"),
            "deleted_at": F.when(F.col("message_id") % 31 == 0, F.col("received_at")),
        }
    )
    return materialise(rows, "dup-rows")


@query
def dup_exact(spark, sf):
    rows = dup_rows(spark, sf, only=[])
    return dedup.exact_duplicates(rows, rows).select("id", "exact_of")


@query
def dup_near(spark, sf):
    rows = dup_rows(spark, sf, only=["amount"])
    return dedup.near_duplicates(rows, rows).select("id", "near_of")


@query
def dup_flags(spark, sf):
    rows = dup_rows(spark, sf, only=["amount"])
    flagged = dedup.flag_duplicates(rows, rows)
    return flagged.filter(F.col("duplicate_status").isNotNull()).select("id", "duplicate_status", "duplicate_of")


@query
def dup_side_by_side(spark, sf):
    return dedup.side_by_side(st.stage(spark, sf, "txn"))


@query
def ttl_cache_hits(spark, sf):
    rows = materialise(keyed_messages(shaped(spark, sf), st.rules(spark, sf)), "cache-rows")
    return dedup.cache_hits(rows).select("message_id", "cache_key", "cache_hit")


# -- balances ----------------------------------------------------------------------------
@query
def balance_effects(spark, sf):
    return posting.balance_effects(st.stage(spark, sf, "txn")).select("id", "effect_account_id", "delta")


@query
def balances_applied(spark, sf):
    return posting.apply_balances(st.stage(spark, sf, "account"), st.stage(spark, sf, "txn")).select(
        "account_id", "balance", "new_balance"
    )


@query
def account_sums(spark, sf):
    return posting.account_sums(st.stage(spark, sf, "txn"))


@query
def running_balance(spark, sf):
    ledger = st.stage(spark, sf, "txn").select("id", "seq", "type", "amount", "account_id", "transfer_to_account_id", "created_at", "deleted_at")
    total = posting.running_balance(ledger, st.stage(spark, sf, "account"), ["created_at", "seq"])
    return total.select("id", "effect_account_id", "delta", "balance_after")


@query
def month_closing(spark, sf):
    return flows.month_closing(st.stage(spark, sf, "txn"), st.stage(spark, sf, "account"))


# -- usage -------------------------------------------------------------------------------
@query
def usage_monthly(spark, sf):
    requests = st.stage(spark, sf, "parse_request")
    return usage.monthly_usage(requests, st.stage(spark, sf, "txn"))


@query
def usage_merged(spark, sf):
    new = usage.monthly_usage(st.stage(spark, sf, "parse_request"), st.stage(spark, sf, "txn"))
    return usage.merge_usage(st.stage(spark, sf, "usage_stored"), new, st.settings(spark))


@query
def quota_admission(spark, sf):
    return usage.quota_admission(
        st.stage(spark, sf, "parse_request"), st.stage(spark, sf, "usage_stored"),
        st.stage(spark, sf, "subscription"), st.settings(spark),
    ).select("request_id", "user_id", "month", "allowed", "used", "limit")


@query
def usage_retention(spark, sf):
    return usage.retained(st.stage(spark, sf, "usage_stored"), run_ts()).select("user_id", "month")


@query
def usage_vs_limits(spark, sf):
    counts = usage.resource_counts(
        accounts=resolve.live(st.stage(spark, sf, "account")),
        categories=resolve.live(st.stage(spark, sf, "category")),
        automations=resolve.live(st.rules(spark, sf)),
        transactions=usage.in_month(st.stage(spark, sf, "txn"), "created_at", ledger_now()),
        ai_parses=usage.in_month(st.stage(spark, sf, "parse_request"), "received_at", message_now()),
    )
    return usage.usage_vs_limits(counts, st.settings(spark), st.stage(spark, sf, "subscription"))


@query
def limit_enforcement(spark, sf):
    """Imports that bring categories of their own, against the limit of categories."""
    held = resolve.live(st.stage(spark, sf, "category"))
    wanted = st.stage(spark, sf, "import_row").select("user_id", "import_id", "Category").distinct()
    limit = resolve.setting(st.settings(spark), "free_categories_limit", 15)
    return usage.enforce_limit(held, wanted, "import_id", limit, st.stage(spark, sf, "subscription"))


@query
def resource_limits(spark, sf):
    """Every resource at its own limit: all rows of imports, categories new to the user, accounts and rules one by one."""
    plans, settings = st.stage(spark, sf, "subscription"), st.settings(spark)
    loads, accounts = st.stage(spark, sf, "import_row"), resolve.live(st.stage(spark, sf, "account"))
    rules, held = resolve.live(st.rules(spark, sf)), resolve.live(st.stage(spark, sf, "category"))
    ledger = usage.in_month(st.stage(spark, sf, "txn"), "created_at", ledger_now())

    def limit(resource, default):
        return resolve.setting(settings, f"free_{resource}_limit", default)

    parts = (
        ("transactions", "import_id", usage.enforce_limit(ledger, loads, "import_id", limit("transactions", 50), plans)),
        ("categories", "import_id", usage.enforce_new(
            held, loads.withColumnRenamed("Category", "name"), "import_id", "name", limit("categories", 15), plans)),
        ("accounts", "account_id", usage.enforce_limit(accounts.limit(0), accounts, "account_id", limit("accounts", 4), plans)),
        ("automations", "rule_id", usage.enforce_limit(rules.limit(0), rules, "rule_id", limit("automations", 5), plans)),
    )
    shown = [
        df.select(F.lit(resource).alias("resource"), "user_id", F.col(key).cast("string").alias("batch"), "held", "wanted", "accepted")
        for resource, key, df in parts
    ]
    out = shown[0]
    for df in shown[1:]:
        out = out.unionByName(df)
    return out


# -- statements --------------------------------------------------------------------------
def imported(spark, sf):
    return statement.import_statement(
        st.stage(spark, sf, "import_row", busy=True), st.stage(spark, sf, "account"), st.slug_categories(spark, sf)
    )


@query
def csv_import(spark, sf):
    return imported(spark, sf).select(
        "row_id", "date", "amount", "description", "category", "category_id", "account_id",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query
def import_audit(spark, sf):
    return statement.import_audit(imported(spark, sf))


@query
def bulk_outcomes(spark, sf):
    rows = parse.validate_parsed(parsed(spark, sf))
    status = F.when(~F.col("is_transaction"), "skipped").when(F.col("reject_reason").isNotNull(), "error").otherwise("success")
    return statement.outcome_tally(rows.select(status.alias("status")))


# -- quality and changes -----------------------------------------------------------------
@query
def constraint_violations(spark, sf):
    ledger, accounts = st.stage(spark, sf, "txn"), st.stage(spark, sf, "account")
    odd = ledger.withColumns(
        {
            "type": F.when(F.col("seq") % 19 == 0, "gift").otherwise(F.col("type")),
            "amount": F.when(F.col("seq") % 23 == 0, -F.col("amount")).otherwise(F.col("amount")),
            "account_id": F.when(F.col("seq") % 29 != 0, F.col("account_id")),
            "time": F.when(F.col("seq") % 31 != 0, F.col("time")),
            "payment_method": F.when(F.col("seq") % 37 == 0, F.repeat(F.lit("x"), 51)).otherwise(F.col("payment_method")),
        }
    )
    found = quality.violations(odd, "transactions", "id", quality.transaction_checks())
    long = accounts.withColumn("last_four", F.concat("last_four", F.when(F.col("is_default"), "x").otherwise("")))
    nature = st.stage(spark, sf, "category").withColumn("spending_nature", F.when(F.col("is_default"), "luxury").otherwise(F.col("spending_nature")))
    named = st.rules(spark, sf).withColumns({
        "name": F.when(F.col("priority") == 100, F.repeat(F.lit("n"), 201)).otherwise(F.col("name")),
        "condition_logic": F.when(F.col("priority") == 90, "xor").otherwise(F.col("condition_logic")),
        "actions": F.when(F.col("priority") != 80, F.col("actions")),
    })
    plans = st.stage(spark, sf, "subscription").withColumn("plan", F.when(F.col("user_id") % 7 == 3, "gold").otherwise(F.col("plan")))
    # reconciliations and imports, one per account and per import
    account = F.col("account_id").cast("bigint")
    checked = accounts.select("account_id", F.when(account % 10 == 0, "odd").when(account % 2 == 0, "pending").otherwise("completed").alias("status"))
    loads = st.stage(spark, sf, "import_row").select("import_id").distinct().withColumn("status", F.when(F.col("import_id") < "3", "lost").otherwise("completed"))
    mute = st.stage(spark, sf, "message").select("message_id", F.col("text").alias("raw_text"))
    for rows, table, key, checks in (
        (long, "accounts", "account_id", quality.account_checks()), (nature, "categories", "category_id", quality.category_checks()),
        (named, "automation_rules", "rule_id", quality.rule_checks()), (plans, "subscriptions", "user_id", quality.subscription_checks()),
        (checked, "reconciliations", "account_id", quality.reconciliation_checks()), (loads, "transaction_imports", "import_id", quality.import_checks()),
        (mute, "skipped_messages", "message_id", quality.skipped_checks()),
    ):
        found = found.unionByName(quality.violations(rows, table, key, checks))
    return found


@query
def uniqueness_violations(spark, sf):
    offered = offered_categories(spark, sf).select("user_id", "slug").unionByName(
        st.stage(spark, sf, "category").select("user_id", "slug")
    )
    usage_rows = st.stage(spark, sf, "message").select("user_id", eventtime.usage_month(F.col("received_at")).alias("month"))
    keys = st.api_keys(spark, sf).select(F.sha2(F.col("user_id").cast("string"), 256).alias("key_hash"))
    plans = st.stage(spark, sf, "account").select("user_id")
    found = quality.not_unique(offered, "categories", ["slug", "user_id"])
    for rows, table, columns in ((usage_rows, "usage_tracking", ["user_id", "month"]), (keys, "api_keys", ["key_hash"]), (plans, "user_subscriptions", ["user_id"])):
        found = found.unionByName(quality.not_unique(rows, table, columns))
    return found


@query
def orphan_rows(spark, sf):
    ledger = st.stage(spark, sf, "txn")
    accounts = resolve.live(st.stage(spark, sf, "account"))
    missing = quality.orphans(ledger, "transactions", "id", "account_id", accounts, "account_id")
    category = quality.orphans(ledger, "transactions", "id", "category_id", resolve.live(st.stage(spark, sf, "category")), "category_id")
    copies = quality.orphans(ledger, "transactions", "id", "duplicate_of", resolve.not_deleted(ledger), "id")
    target = quality.orphans(ledger, "transactions", "id", "transfer_to_account_id", accounts, "account_id")
    loads = st.stage(spark, sf, "import_row").select("import_id").distinct().filter(F.col("import_id") != "5")
    load = quality.orphans(ledger, "transactions", "id", "import_id", loads, "import_id")
    named = st.rules(spark, sf).withColumn("account_id", F.get_json_object("actions", "$.set_account"))
    rule = quality.orphans(named, "automation_rules", "rule_id", "account_id", accounts, "account_id")
    wallet = quality.orphans(named, "automation_rules", "rule_id", "transfer_to_account_id", accounts, "account_id")
    return missing.unionByName(category).unionByName(copies).unionByName(target).unionByName(load).unionByName(rule).unionByName(wallet)


@query
def cascade_delete(spark, sf):
    accounts = st.stage(spark, sf, "account")
    gone = accounts.filter(F.col("deleted_at").isNotNull()).select("account_id")
    kept = mutate.cascade(st.stage(spark, sf, "txn"), "account_id", gone)
    kept = mutate.set_null(kept, "transfer_to_account_id", gone.withColumnRenamed("account_id", "transfer_to_account_id"))
    return kept.select("id", "account_id", "transfer_to_account_id")


@query
def cascade_imports(spark, sf):
    """Deleted imports and categories leave the ledger's references NULL."""
    gone = st.stage(spark, sf, "import_row").filter(F.col("import_id") < "3").select("import_id").distinct()
    lost = st.stage(spark, sf, "category").filter(F.col("deleted_at").isNotNull()).select("category_id")
    kept = mutate.set_null(mutate.set_null(st.stage(spark, sf, "txn"), "import_id", gone), "category_id", lost)
    return kept.select("id", "import_id", "category_id")


@query
def cascade_children(spark, sf):
    """Deleting an account takes its reconciliations along, deleting a parent category its children."""
    accounts, tree = st.stage(spark, sf, "account"), st.stage(spark, sf, "category")
    gone = accounts.filter(F.col("deleted_at").isNotNull()).select("account_id")
    reconciled = mutate.cascade(accounts.select("account_id", F.concat(F.lit("rec-"), "account_id").alias("id")), "account_id", gone)
    parents = tree.filter(F.col("parent_id").isNull() & (F.substring("category_id", 2, 1).cast("int") % 2 == 0)).select(F.col("category_id").alias("parent_id"))
    children = mutate.cascade(tree, "parent_id", parents)
    return reconciled.select("id").unionByName(children.select(F.concat(F.lit("cat-"), "category_id").alias("id")))


@query
def statement_file(spark, sf):
    """A statement written as CSV and read back: what is imported, with its constants and the row it came from."""
    rows = st.stage(spark, sf, "import_row")
    path = shared_dir(spark, "statement-file")
    named = rows.select("Date", "Amount", "Category", "Account", "Note", F.concat_ws("/", "import_id", "row_id", F.col("user_id").cast("string")).alias("Labels"))
    named.write.option("header", True).csv(path)
    back = src.read_statement(spark, path)
    parts = F.split("Labels", "/")
    keyed = back.withColumns({"import_id": parts[0], "row_id": parts[1], "user_id": parts[2].cast("bigint"), "Labels": F.lit(None).cast("string")})
    done = statement.import_statement(keyed, st.stage(spark, sf, "account"), st.slug_categories(spark, sf))
    return done.select("row_id", "date", "amount", "type", "payment_method", "source", "confidence",
                       F.get_json_object("raw_text", "$.Category").alias("raw_category"))


@query
def ledger_files(spark, sf):
    """The ledger appended by month, exported as CSV and read back, beside the rows changed since a moment."""
    ledger, out = st.stage(spark, sf, "txn"), shared_dir(spark, "ledger-files")
    sinks.append_ledger(ledger, f"{out}/ledger")
    stored = src.read_table(spark, f"{out}/ledger").drop("month")
    sinks.export_csv(stored.select("id", "date", "amount", "description"), f"{out}/csv")
    shown = spark.read.option("header", True).schema("id string, date date, amount decimal(15,2), description string").csv(f"{out}/csv")
    changed = sinks.changes_since(stored, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("id", F.lit(True).alias("changed"))
    return shown.join(changed, "id", "left").select("id", "date", "amount", "description", F.coalesce("changed", F.lit(False)).alias("changed"))


@query
def soft_delete(spark, sf):
    ledger = st.stage(spark, sf, "txn")
    ids = ledger.filter(F.col("duplicate_status").isNotNull()).select("id")
    gone = mutate.soft_delete(ledger, ids, "id", run_ts())
    changed = ~F.col("deleted_at").eqNullSafe(F.col("old_deleted_at"))
    old = gone.withColumn("old_deleted_at", F.when(F.col("duplicate_status").isNull(), F.col("deleted_at")))
    return mutate.stamp(old, run_ts(), changed).select("id", "deleted_at", "updated_at")


@query
def bulk_edit(spark, sf):
    ledger = st.stage(spark, sf, "txn")
    edits = ledger.filter(F.col("duplicate_status").isNotNull()).select(
        "id", F.when(F.col("seq") % 2 == 0, "income").alias("type"), F.lit("4").alias("category_id"), F.lit(None).cast("string").alias("account_id"),
    )
    return mutate.bulk_edit(ledger, edits).select("id", "type", "category_id", "account_id")


@query
def duplicate_resolution(spark, sf):
    ledger = st.stage(spark, sf, "txn")
    choice = F.when(F.col("seq") % 3 == 0, "keep_both").when(F.col("seq") % 3 == 1, "delete_flagged").otherwise("replace")
    decisions = ledger.filter(F.col("duplicate_status").isNotNull()).select("id", choice.alias("decision"))
    return mutate.resolve_duplicates(ledger, decisions, run_ts()).select("id", "duplicate_status", "duplicate_of", "deleted_at")


@query
def balance_adjust(spark, sf):
    accounts = st.stage(spark, sf, "account")
    sums = posting.account_deltas(st.stage(spark, sf, "txn")).select(
        "account_id", F.greatest(F.col("delta"), F.lit(0)).cast("decimal(15,2)").alias("target_balance")
    )
    return mutate.adjust_balances(accounts, sums)


@query
def category_unlink(spark, sf):
    held, ledger = st.stage(spark, sf, "category"), st.stage(spark, sf, "txn")
    ids = held.filter(F.col("spending_nature").isin("want", "need")).select("category_id")
    _, unlinked, refused = mutate.delete_categories(held, ledger, ids)
    return unlinked.select("id", "category_id").unionByName(refused.select(F.lit("refused").alias("id"), "category_id"))


# -- reports -----------------------------------------------------------------------------
@query
def net_worth(spark, sf):
    return reports.net_worth(st.stage(spark, sf, "account"))


@query
def month_summary(spark, sf):
    return reports.month_summary(st.stage(spark, sf, "txn"))


@query
def spending_by_category(spark, sf):
    return reports.spending_by_category(st.stage(spark, sf, "txn"), st.stage(spark, sf, "category"))


@query
def category_counts(spark, sf):
    return reports.category_counts(st.stage(spark, sf, "txn"), st.stage(spark, sf, "category"))


@query
def recent_10(spark, sf):
    return reports.recent(st.stage(spark, sf, "txn")).select("id", "user_id", "date", "time", "amount")


@query
def top_categories(spark, sf):
    return reports.top_categories(st.stage(spark, sf, "txn"), st.stage(spark, sf, "category")).select(
        "user_id", "category_id", "name", "spent"
    )


@query
def ledger_page(spark, sf):
    return reports.page(st.stage(spark, sf, "txn"), 100, ("1998-06-30", "1")).select("id", "date", "amount")


@query
def ledger_search(spark, sf):
    since, until = reports.period("last_month", F.lit("1998-03-15").cast("date"))
    year, end = reports.period("this_year", F.lit("1997-03-15").cast("date"))
    ledger = st.stage(spark, sf, "txn")
    found = reports.search(ledger, types=["expense", "income"], since=since, until=until, text="Restaurante")
    return found.unionByName(reports.search(ledger, category_id="7", since=year, until=end)).select("id", "date", "type", "amount")


@query
def present_values(spark, sf):
    signed = F.when(F.col("seq") % 7 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("decimal(15,2)")
    return st.stage(spark, sf, "txn").select(
        "id", present.pesos(signed).alias("shown_amount"), present.capitalise_words(F.col("description")).alias("shown_text"),
        present.confidence_label(F.when(F.col("seq") % 9 != 0, F.col("confidence") + F.lit(0.5))).alias("shown_confidence"),
        eventtime.to_slashed(F.col("date").cast("string")).alias("shown_date"),
    )


@query
def confirmations(spark, sf):
    rows = dup_rows(spark, sf).withColumns(
        {"account_id": F.col("last_four").cast("int").cast("string"), "transfer_rule_name": F.when(F.col("phone").isNotNull(), "Ahorro")}
    )
    return reports.confirmations(rows, st.stage(spark, sf, "account")).select("id", "confirmation")


# -- the whole path ----------------------------------------------------------------------
def ingested(spark, sf):
    return flows.ingest(
        shaped(spark, sf), st.stage(spark, sf, "account"), st.slug_categories(spark, sf), st.rules(spark, sf)
    )


@query
def ledger_posted(spark, sf):
    return ingested(spark, sf).ledger.select(
        "id", "message_id", "user_id", "channel", "source", "date", "time", "amount", "type", "account_id", "category_id",
        "transfer_to_account_id", "description", "notes", "duplicate_status", "duplicate_of",
    )


def record_fields(column):
    """Fields of a stored record, typed again, so that engines may write their JSON as they like."""
    def field(name):
        return F.get_json_object(column, f"$.{name}")

    return [field("amount").cast("decimal(15,2)").alias("amount"), field("confidence").cast("bigint").alias("confidence"),
            field("is_transaction").cast("boolean").alias("is_transaction"),
            *[field(n).alias(n) for n in ("description", "category", "bank", "payment_type", "original_date", "original_time", "last_four", "account_type", "skip_reason")],
            field("source").alias("parsed_source")]


@query
def ledger_record(spark, sf):
    """What is stored beside a ledger row: payment method, confidence and the whole parsed record."""
    done = flows.ingest(shaped(spark, sf), st.stage(spark, sf, "account"), st.slug_categories(spark, sf), st.rules(spark, sf))
    return done.ledger.select("id", "payment_method", "raw_text", *record_fields("parsed_data"))


@query
def skipped_audit(spark, sf):
    """Skipped messages with their source and the whole parsed record."""
    done = parse.skipped(parsed(spark, sf))
    return done.select("message_id", F.col("source").alias("stored_source"), "reason", *record_fields("parsed_data"))


@query
def ledger_rejects(spark, sf):
    return ingested(spark, sf).rejects


# -- streams -----------------------------------------------------------------------------
#: Parts that a table arrives in.
ARRIVALS = 3


def run_in_parts(spark, sf, table, at, start):
    """Let a table arrive part by part in the order of ``at``; after each part ``start(stream)`` runs to its end and stops.

    So every stream sees several micro-batches and goes on from its checkpoint twice.
    """
    given, folder = st.raw(spark, sf, table), shared_dir(spark, f"arriving-{table}")
    cuts = given.select(at.cast("double").alias("at")).approxQuantile("at", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.01)
    part = F.lit(0)
    for cut in cuts:
        part = part + F.coalesce(at.cast("double") >= cut, F.lit(False)).cast("int")
    for number in range(ARRIVALS):
        src.spread(given.filter(part == number)).write.mode("append").parquet(folder)
        start(spark.readStream.schema(given.schema).parquet(folder)).awaitTermination()


def run_events(spark, sf, view, start):
    """Events by arrival, staged as one of their views."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    run_in_parts(spark, sf, "events", at, lambda events: start(st.stage_from(spark, view, events=events)))


@query
def stream_ingest(spark, sf):
    out = shared_dir(spark, "stream-ingest")
    dims = st.stage(spark, sf, "account"), st.slug_categories(spark, sf), st.rules(spark, sf)
    run_events(spark, sf, "message", lambda rows: jobs.ingest_stream(src.by_channel(rows), *dims, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/ledger").select(
        "id", "message_id", "user_id", "channel", "source", "date", "time", "amount", "type", "account_id", "category_id",
        "transfer_to_account_id", "description", "notes", "duplicate_status", "duplicate_of",
    )


def keyed_messages(rows, rule_table):
    """What the cache sees: the text with its owner's context, and whether the result is one that is stored."""
    book = rules.rule_book(rule_table, keep=True)
    parsed_rows = parse.parse_messages(rules.context_json(rows.filter(F.col("problem").isNull()), book))
    refused = parse.reject_reason(F.col("amount"), F.col("description"), F.col("category"), F.col("is_transaction"))
    return parsed_rows.select(
        "message_id", (F.col("is_transaction") & refused.isNull()).alias("is_transaction"),
        dedup.cache_key(F.col("text"), F.col("context")).alias("cache_key"),
        eventtime.epoch_second(F.col("received_at")).alias("second"),
    )


@query
def stream_dedup(spark, sf):
    out = shared_dir(spark, "stream-dedup")
    book = rules.rule_book(st.rules(spark, sf), keep=True)
    def start(rows):
        return jobs.cache_stream(src.by_channel(rows), out, f"{out}/checkpoint", keyed=lambda batch: keyed_messages(batch, book))

    run_events(spark, sf, "message", start)
    return spark.read.parquet(f"{out}/flagged").select("message_id", "cache_key", "cache_hit")


@query
def stream_balances(spark, sf):
    out = shared_dir(spark, "stream-balances")
    customer = st.raw(spark, sf, "customer")

    def start(orders):
        return jobs.balance_stream(st.stage_from(spark, "txn", orders=orders, customer=customer), out, f"{out}/checkpoint")

    run_in_parts(spark, sf, "orders", F.col("o_orderkey"), start)
    return jobs.latest_balances(spark, out)


@query
def stream_quota(spark, sf):
    out = shared_dir(spark, "stream-quota")
    dims = st.stage(spark, sf, "usage_stored"), st.stage(spark, sf, "subscription"), st.settings(spark)
    run_events(spark, sf, "parse_request", lambda rows: jobs.quota_stream(rows, *dims, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/decided").select("request_id", "user_id", "month", "allowed", "used", "limit")
