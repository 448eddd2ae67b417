"""Category tree, provisioning, upserts and names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.fixed_values import CATEGORY_TREE, RENAMED_SLUGS
from tallywell.functions.present import localised, slug
from tallywell.plans.skew import lookup


def default_template(spark: SparkSession, translations: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """The default tree: (slug, name, type, spending_nature, parent_slug, translations).

    ``translations`` gives names by slug and language; the English name is always there.
    """
    rows = []
    for parent, name, kind, nature, children in CATEGORY_TREE:
        rows.append((parent, name, kind, nature, None))
        rows += [(s, n, kind, child_nature, parent) for s, n, child_nature in children]
    named = [(*row, {"en": row[1]} | dict((translations or {}).get(row[0], {}))) for row in rows]
    return spark.createDataFrame(
        named, "slug string, name string, type string, spending_nature string, parent_slug string, translations map<string,string>"
    )


def category_id(user_id: Column, slug_col: Column) -> Column:
    """Stable id, so children can name their parent without a second pass."""
    return F.sha2(F.concat_ws("|", F.lit("category"), user_id, slug_col), 256)


def provision_categories(users: DataFrame, template: DataFrame) -> DataFrame:
    """The template's categories for each new user, children wired to their parents.

    The template is one small array read as a scalar and unrolled per user.
    """
    columns = ["slug", "name", "type", "spending_nature", "parent_slug", "translations"]
    entries = template.agg(F.collect_list(F.struct(*columns)).alias("entries")).scalar()
    user = F.col("user_id")
    return (
        users.select("user_id")
        .distinct()
        .withColumn("entry", F.explode(entries))
        .select("user_id", "entry.*")
        .select(
            category_id(user, F.col("slug")).alias("category_id"),
            "user_id", "name", "slug", "type", "spending_nature",
            F.when(
                F.col("parent_slug").isNotNull(), category_id(user, F.col("parent_slug"))
            ).alias("parent_id"),
            F.lit(True).alias("is_default"),
            "translations",
        )
    )


def provision_accounts(users: DataFrame) -> DataFrame:
    """The cash account every new user starts with."""
    return users.select("user_id").distinct().select(
        F.sha2(F.concat_ws("|", F.lit("account"), "user_id", F.lit("cash")), 256).alias("account_id"),
        "user_id",
        F.lit("Cash").alias("name"),
        F.lit("cash").alias("type"),
        F.lit("cash").alias("institution"),
        F.lit("COP").alias("currency"),
        F.lit(0).cast("decimal(15,2)").alias("balance"),
        F.lit(True).alias("is_active"),
        F.lit(True).alias("is_default"),
    )


def provision_subscriptions(users: DataFrame) -> DataFrame:
    return users.select("user_id").distinct().select(
        "user_id", F.lit("free").alias("plan"), F.lit("active").alias("status")
    )


def category_tree(categories: DataFrame) -> DataFrame:
    """Each category with its parent's slug and name (the tree is two levels deep)."""
    parents = categories.select(
        F.col("category_id").alias("parent_id"), F.col("slug").alias("parent_slug"),
        F.col("name").alias("parent_name"),
    )
    return lookup(categories, parents, ["parent_id"])


def upsert_categories(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, orphans) of incoming (user_id, slug, name, type, spending_nature, parent_slug, translations).

    A known slug gets the incoming metadata, translations included, and keeps the user's own name and id; an unknown
    one is inserted. A child whose parent the user has neither now nor after the insert of
    the parents is an orphan and left out.
    """
    keys = ["user_id", "slug"]
    offered = incoming.select(
        *keys, F.col("name").alias("new_name"), F.col("type").alias("new_type"),
        F.col("spending_nature").alias("new_nature"), "parent_slug", F.col("translations").alias("new_translations"),
    )
    parents = (
        existing.select(*keys, "category_id")
        .unionByName(
            incoming.filter(F.col("parent_slug").isNull())
            .join(existing.select(*keys), keys, "left_anti")
            .select(*keys, category_id(F.col("user_id"), F.col("slug")).alias("category_id"))
        )
        .groupBy(*keys)
        .agg(F.min("category_id").alias("new_parent_id"))
        .withColumnRenamed("slug", "parent_slug")
    )
    placed = offered.join(parents, ["user_id", "parent_slug"], "left")
    is_orphan = F.col("parent_slug").isNotNull() & F.col("new_parent_id").isNull()
    orphans = placed.filter(is_orphan).select(*keys, "parent_slug")
    wanted = placed.filter(~is_orphan).withColumn("is_offered", F.lit(True))
    merged = existing.join(wanted, keys, "full")
    offered_here, known = F.col("is_offered").isNotNull(), F.col("category_id").isNotNull()

    def pick(new: str, old: str) -> Column:
        return F.when(offered_here, F.col(new)).otherwise(F.col(old)).alias(old)

    return (
        merged.select(
            *keys,
            F.coalesce("category_id", category_id(F.col("user_id"), F.col("slug"))).alias("category_id"),
            F.coalesce("name", "new_name").alias("name"),
            pick("new_type", "type"),
            pick("new_nature", "spending_nature"),
            pick("new_translations", "translations"),
            F.when(
                offered_here & F.col("parent_slug").isNotNull(), F.col("new_parent_id")
            ).otherwise(F.col("parent_id")).alias("parent_id"),
            F.when(offered_here, F.lit(True)).otherwise(F.col("is_default")).alias("is_default"),
            F.when(~known, "inserted").when(offered_here, "updated").otherwise("kept").alias("outcome"),
        ),
        orphans,
    )


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus the incoming ones whose key is new; one row per new key."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
    fresh = once.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def backfill_slugs(categories: DataFrame) -> DataFrame:
    return categories.withColumn("slug", F.coalesce("slug", slug(F.col("name"))))


def current_slug(slug_col: Column) -> Column:
    """The slug that replaced a renamed one."""
    table = F.create_map(*[F.lit(x) for pair in RENAMED_SLUGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, slug_col), slug_col)


def localise_names(categories: DataFrame, locale: str) -> DataFrame:
    return categories.withColumn(
        "local_name", localised(F.col("translations"), locale, F.col("name"))
    )


def default_phone_rules(accounts: DataFrame, categories: DataFrame, phone: str) -> DataFrame:
    """A transfer rule to each owner's wallet account, where the owner has a transfer category."""
    wallets = accounts.filter(F.col("institution") == "nequi").select("user_id", "account_id")
    chosen = categories.filter(F.col("slug") == "transfer")
    category = chosen.groupBy("user_id").agg(F.min("category_id").alias("category_id"))
    return lookup(wallets, category, ["user_id"], "inner").select(
        F.sha2(F.concat_ws("|", F.lit("wallet-rule"), "account_id"), 256).alias("rule_id"),
        "user_id",
        F.lit("Transfer to Personal Nequi").alias("name"),
        F.lit(200).alias("priority"),
        F.lit(True).alias("is_active"),
        F.lit(phone).alias("match_phone"),
        F.col("account_id").alias("transfer_to_account_id"),
        F.to_json(F.struct(F.array(F.lit("Transferiste"), F.lit(f"*{phone}")).alias("contains_text"))).alias("conditions"),
        F.to_json(F.struct(F.col("category_id").alias("set_category"), F.col("account_id").alias("link_account"))).alias("actions"),
    )
