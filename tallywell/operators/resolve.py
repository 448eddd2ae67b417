"""Names to ids: owners, accounts, categories, settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.fixed_values import FREE_AI_PARSES_LIMIT, FREE_TRANSACTIONS_LIMIT
from tallywell.plans.skew import is_small, lookup
from tallywell.session import materialise


def live(df: DataFrame) -> DataFrame:
    """Active rows that are not soft-deleted; a NULL flag is not active."""
    return df.filter((F.col("is_active") == F.lit(True)) & F.col("deleted_at").isNull())


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def owned_by(df: DataFrame, user_id) -> DataFrame:
    return df.filter(F.col("user_id") == F.lit(user_id))


def _first_id(df: DataFrame, keys: Sequence[str], id_col: str, out: str) -> DataFrame:
    """One row per key: the id of the first row by (name, id), pre-aggregated on the map side."""
    first = F.min(F.struct("name", id_col)).getField(id_col)
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(first.alias(out))


# -- owners ------------------------------------------------------------------------------
def attribute_owner(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Add ``user_id`` of the active key whose SHA-256 the request's ``api_key`` hashes to."""
    owners = api_keys.filter(F.col("is_active") == F.lit(True)).select("key_hash", "user_id")
    hashed = requests.withColumn("key_hash", F.sha2(F.col("api_key"), 256))
    return lookup(hashed, owners, ["key_hash"])


def last_key_use(attributed: DataFrame) -> DataFrame:
    """When each known key was last used."""
    return (
        attributed.filter(F.col("user_id").isNotNull())
        .groupBy("key_hash")
        .agg(F.max("received_at").alias("last_used_at"))
    )


# -- accounts ----------------------------------------------------------------------------
ACCOUNT_PROBE = ["user_id", "bank", "last_four", "account_type"]
CASCADE = [
    ["user_id", "bank", "last_four", "account_type"],
    ["user_id", "bank", "last_four"],
    ["user_id", "bank", "account_type"],
    ["user_id", "bank"],
]


def resolve_accounts(facts: DataFrame, accounts: DataFrame, written: bool = False) -> DataFrame:
    """Add ``cascade_account_id`` and ``cascade_tier`` for (user, bank, last four, type).

    Four lookups from the narrowest key to the widest, each against a table that holds one
    row per key, so no message ever meets all accounts of its owner. The first hit counts.
    When the accounts are too many to broadcast, each distinct combination is resolved once
    and joined back, and only the accounts that one of few combinations asks for are grouped. The
    facts are written down for that, unless they are ``written`` already.
    """
    known = live(accounts).select(
        "user_id",
        F.col("institution").alias("bank"),
        "last_four",
        F.col("type").alias("account_type"),
        "name",
        "account_id",
    )

    small = is_small(known)

    def cascade(probes: DataFrame, few: bool) -> DataFrame:
        asked = probes
        for tier, keys in enumerate(CASCADE, start=1):
            asked_for = known if small or not few else known.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
            ids = _first_id(asked_for, keys, "account_id", f"_tier{tier}")
            probes = lookup(probes, ids, keys, known_small=few)
        tiers = [F.col(f"_tier{t}") for t in range(1, 5)]
        hit = F.coalesce(*[F.when(c.isNotNull(), F.lit(t)) for t, c in enumerate(tiers, 1)])
        return probes.withColumns(
            {"cascade_account_id": F.coalesce(*tiers), "cascade_tier": hit}
        ).drop("_tier1", "_tier2", "_tier3", "_tier4")

    if small:
        return cascade(facts, True)
    facts = facts if written else materialise(facts, "facts")
    # NULL parts cannot be joined back on, so they travel as a marker no bank or type uses
    marked = {c: F.coalesce(F.col(c), F.lit("\0")) for c in ACCOUNT_PROBE[1:]}
    plain = {c: F.nullif(F.col(c), F.lit("\0")) for c in ACCOUNT_PROBE[1:]}
    probes = materialise(facts.select(*ACCOUNT_PROBE).withColumns(marked).distinct(), "probes")
    few = is_small(probes)
    resolved = materialise(cascade(probes.withColumns(plain), few).withColumns(marked), "cascade")
    return lookup(facts.withColumns(marked), resolved, ACCOUNT_PROBE, known_small=few).withColumns(plain)


def default_accounts(accounts: DataFrame) -> DataFrame:
    """Per user the first cash and the first bancolombia account."""

    def first(institution: str):
        row = F.when(F.col("institution") == institution, F.struct("name", "account_id"))
        return F.min(row).getField("account_id").alias(f"{institution}_account_id")

    return live(accounts).groupBy("user_id").agg(first("cash"), first("bancolombia"))


def with_fallback(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add ``account_id`` (NULL where the channel refuses the message) from the cascade.

    Expects ``cascade_account_id``, ``channel`` and, where detection ran,
    ``detected_account_id``. API and chat prefer a detected account; API and the preview
    fall back to cash, then bancolombia; chat to cash only; e-mail not at all.
    """
    small = is_small(live(accounts).select("user_id"))
    joined = lookup(facts, default_accounts(accounts), ["user_id"], known_small=small, costly=True)
    channel, cascade = F.col("channel"), F.col("cascade_account_id")
    cash, bank = F.col("cash_account_id"), F.col("bancolombia_account_id")
    detected = (
        F.col("detected_account_id")
        if "detected_account_id" in facts.columns
        else F.lit(None).cast("string")
    )
    account = (
        F.when(channel == "email", cascade)
        .when(channel == "chat", F.coalesce(detected, cascade, cash))
        .otherwise(F.coalesce(detected, cascade, cash, bank))
    )
    return joined.withColumn("account_id", account).drop(
        "cash_account_id", "bancolombia_account_id"
    )


def balance_lookup(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balance of (account, user); NULL where there is no such account, 0 for a NULL balance."""
    known = not_deleted(accounts).select(
        "account_id", "user_id", F.coalesce("balance", F.lit(0).cast("decimal(15,2)")).alias("balance")
    )
    return lookup(requests, known, ["account_id", "user_id"])


# -- categories --------------------------------------------------------------------------
def resolve_categories(
    facts: DataFrame, categories: DataFrame, slug: str = "category", out: str = "category_id"
) -> DataFrame:
    """Add the id of the user's live category with the slug, NULL where there is none."""
    known = live(categories)
    ids = _first_id(known, ["user_id", "slug"], "category_id", out).withColumnRenamed("slug", slug)
    return lookup(facts, ids, ["user_id", slug], known_small=is_small(known), costly=True)


def named_category(categories: DataFrame, slug: str, out: str) -> DataFrame:
    """Per user the id of one category, for example 'missing' or 'transfer'."""
    chosen = live(categories).filter(F.col("slug") == slug)
    return _first_id(chosen, ["user_id"], "category_id", out)


# -- settings and plans ------------------------------------------------------------------
def setting(settings: DataFrame, key: str, fallback: int):
    """One numeric setting as a scalar column; the fallback where it is absent or no number."""
    value = F.col("value").try_cast("int")
    one = settings.filter(F.col("key") == key).agg(F.max(value).alias("value"))
    return F.coalesce(one.scalar(), F.lit(fallback))


def settings_row(settings: DataFrame) -> DataFrame:
    """All settings as one row, numeric, with the two documented fallbacks filled in."""
    keys = ["free_ai_parses_limit", "free_transactions_limit", "free_accounts_limit",
            "free_automations_limit", "free_categories_limit"]
    row = settings.groupBy().pivot("key", keys).agg(F.max(F.col("value").try_cast("int")))
    return row.withColumns(
        {
            "free_ai_parses_limit": F.coalesce(
                F.col("free_ai_parses_limit"), F.lit(FREE_AI_PARSES_LIMIT)
            ),
            "free_transactions_limit": F.coalesce(
                F.col("free_transactions_limit"), F.lit(FREE_TRANSACTIONS_LIMIT)
            ),
        }
    )


def pro_users(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.filter((F.col("plan") == "pro") & (F.col("status") == "active"))
        .select("user_id")
        .distinct()
        .withColumn("is_pro", F.lit(True))
    )


def with_pro_flag(facts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    joined = lookup(facts, pro_users(subscriptions), ["user_id"], costly=True)
    return joined.withColumn("is_pro", F.coalesce("is_pro", F.lit(False)))
