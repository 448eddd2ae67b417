"""Ledger rows to balance effects, balances and running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.plans.skew import lookup, running_total

MONEY = "decimal(15,2)"
TOTAL = "decimal(38,2)"


def balance_effects(ledger: DataFrame) -> DataFrame:
    """(ledger columns, effect_account_id, delta): what each row does to which account.

    An expense takes from its account, income adds; a transfer moves money only when it
    names the other account.
    """
    amount, none = F.col("amount"), F.lit(None).cast("string")
    to = F.col("transfer_to_account_id")

    def effect(account: Column, delta: Column) -> Column:
        return F.struct(
            account.cast("string").alias("effect_account_id"), delta.cast(MONEY).alias("delta")
        )

    account, kind = F.col("account_id"), F.col("type")
    effects = F.array_compact(
        F.array(
            F.when(kind == "expense", effect(account, -amount)),
            F.when(kind == "income", effect(account, amount)),
            F.when((kind == "transfer") & to.isNotNull(), effect(account, -amount)),
            F.when((kind == "transfer") & to.isNotNull(), effect(to, amount)),
        )
    )
    return ledger.withColumn("_effect", F.explode(effects)).select(*ledger.columns, "_effect.*")


def account_deltas(ledger: DataFrame) -> DataFrame:
    """Net effect per account; partial sums on the map side keep a busy account cheap."""
    return (
        balance_effects(ledger)
        .groupBy(F.col("effect_account_id").alias("account_id"))
        .agg(
            F.sum("delta").cast(TOTAL).alias("delta"),
            F.count(F.lit(1)).alias("effects"),
        )
    )


def apply_balances(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accounts with ``new_balance`` = stored balance (NULL as 0) plus the ledger's effects.

    Both sides hold one row per account, so neither can be skewed.
    """
    zero = F.lit(0).cast(TOTAL)
    return accounts.join(account_deltas(ledger), "account_id", "left").withColumn(
        "new_balance",
        (F.coalesce(F.col("balance").cast(TOTAL), zero) + F.coalesce("delta", zero)).cast(TOTAL),
    )


def account_sums(ledger: DataFrame) -> DataFrame:
    """Gross amounts per account and type."""
    return ledger.groupBy("account_id", "type").agg(
        F.sum("amount").cast(TOTAL).alias("total"), F.count(F.lit(1)).alias("transactions")
    )


def running_balance(
    ledger: DataFrame, accounts: DataFrame, order: list[str]
) -> DataFrame:
    """Each effect with its account's balance after it, in posting ``order``."""
    effects = balance_effects(ledger).filter(F.col("effect_account_id").isNotNull())
    total = running_total(
        effects, ["effect_account_id"], order, F.col("delta"), "moved"
    )
    opening = accounts.select(
        F.col("account_id").alias("effect_account_id"),
        F.coalesce("balance", F.lit(0).cast(MONEY)).alias("opening"),
    )
    return lookup(total, opening, ["effect_account_id"], costly=True).withColumn(
        "balance_after",
        (F.coalesce(F.col("opening"), F.lit(0).cast(MONEY)) + F.col("moved")).cast(TOTAL),
    )
