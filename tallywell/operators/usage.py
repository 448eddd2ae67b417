"""Monthly usage counters, quota admission, retention and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.fixed_values import RETENTION_MONTHS
from tallywell.functions.eventtime import usage_month
from tallywell.operators.resolve import setting, with_pro_flag
from tallywell.plans.skew import first_rows, lookup, running_total
from tallywell.session import materialise


def monthly_usage(parses: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parse requests by arrival and ledger rows by creation, per user and UTC month, in one pre-aggregated pass."""
    counted = parses.select(
        "user_id", usage_month(F.col("received_at")).alias("month"),
        F.lit(1).alias("parses"), F.lit(0).alias("postings"),
    ).unionAll(
        ledger.select(
            "user_id", usage_month(F.col("created_at")).alias("month"), F.lit(0), F.lit(1)
        )
    )
    return counted.groupBy("user_id", "month").agg(
        F.sum("parses").alias("ai_parses_used"), F.sum("postings").alias("transactions_count")
    )


def merge_usage(stored: DataFrame, new: DataFrame, settings: DataFrame) -> DataFrame:
    """Upsert: stored counters plus new ones; a month first seen opens with today's limits."""
    added = new.select(
        "user_id", "month",
        F.col("ai_parses_used").alias("new_parses"), F.col("transactions_count").alias("new_postings"),
    )
    parse_limit = setting(settings, "free_ai_parses_limit", 15)
    posting_limit = setting(settings, "free_transactions_limit", 50)

    def total(old: str, extra: str) -> Column:
        return F.coalesce(old, F.lit(0)) + F.coalesce(extra, F.lit(0))

    return stored.join(added, ["user_id", "month"], "full").select(
        "user_id",
        "month",
        total("ai_parses_used", "new_parses").cast("bigint").alias("ai_parses_used"),
        F.coalesce("ai_parses_limit", parse_limit).alias("ai_parses_limit"),
        total("transactions_count", "new_postings").cast("bigint").alias("transactions_count"),
        F.coalesce("transactions_limit", posting_limit).alias("transactions_limit"),
    )


def quota_admission(
    requests: DataFrame, stored: DataFrame, subscriptions: DataFrame, settings: DataFrame
) -> DataFrame:
    """Add (allowed, used, limit) to parse requests in arrival order per user and month.

    The n-th request of a month is admitted while prior + n stays within the limit; a denied
    one uses nothing up. Pro users are always admitted and see limit -1. The limit comes from
    the settings, not from the stored month. Requests are numbered through ranges of the
    arrival order, so one user with most of the requests, or one moment, is still many tasks.
    """
    ordered = running_total(
        requests.withColumn("month", usage_month(F.col("received_at"))),
        ["user_id", "month"],
        ["received_at", "request_id"],
        F.lit(1).cast("bigint"),
        "n",
    )
    prior = stored.select("user_id", "month", F.col("ai_parses_used").cast("bigint").alias("prior"))
    known = with_pro_flag(lookup(ordered, prior, ["user_id", "month"], costly=True), subscriptions)
    before = F.coalesce("prior", F.lit(0).cast("bigint"))
    limit = setting(settings, "free_ai_parses_limit", 15).cast("bigint")
    reached = before + F.col("n")
    return known.select(
        *requests.columns,
        "month",
        (F.col("is_pro") | (reached <= limit)).alias("allowed"),
        F.when(F.col("is_pro"), reached)
        .otherwise(F.least(reached, F.greatest(limit, before)))
        .alias("used"),
        F.when(F.col("is_pro"), F.lit(-1).cast("bigint")).otherwise(limit).alias("limit"),
    )


def retained(usage: DataFrame, now: Column) -> DataFrame:
    """Usage of the last twelve calendar months; older months go."""
    cutoff = F.date_format(F.add_months(F.to_date(now), -RETENTION_MONTHS), "yyyy-MM")
    return usage.filter(F.col("month") >= cutoff)


RESOURCES = ["ai_parses", "transactions", "accounts", "categories", "automations"]


MONTHLY = ["ai_parses", "transactions"]  # limits per calendar month; the others are totals


def in_month(df: DataFrame, when: str, now: Column) -> DataFrame:
    """The rows whose moment lies in the month of ``now``."""
    return df.filter(usage_month(F.col(when)) == usage_month(now))


def usage_vs_limits(counts: DataFrame, settings: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(user, resource, used) beside the resource's limit; an active pro plan has none, shown as -1.

    Monthly resources are counted over the current month by whoever makes ``counts``.
    """
    limits = settings.select(
        F.regexp_replace(F.regexp_replace("key", "^free_", ""), "_limit$", "").alias("resource"),
        F.col("value").try_cast("bigint").alias("limit"),
    ).filter(F.col("resource").isin(*RESOURCES))
    known = with_pro_flag(lookup(counts, limits, ["resource"]), subscriptions)
    over = ~F.col("is_pro") & F.coalesce(F.col("used") > F.col("limit"), F.lit(False))
    shown = F.when(F.col("is_pro"), F.lit(-1).cast("bigint")).otherwise(F.col("limit"))
    return known.select("user_id", "resource", "used", shown.alias("limit"), over.alias("over_limit"))


def resource_counts(**tables: DataFrame) -> DataFrame:
    """Rows per user of each named table, as (user_id, resource, used)."""
    parts = [
        df.groupBy("user_id").agg(F.count(F.lit(1)).alias("used")).withColumn("resource", F.lit(name))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("user_id", "resource", "used")


SLICES = 64  # parts of one user's batches of one size before their first ones are picked
HEAD_SETS = 2_000  # sets of one user that one round folds


def _owner(user: Column) -> Column:
    """A key that is never missing: rows without a user belong to one unnamed user."""
    return F.coalesce(F.concat(F.lit("u"), user.cast("string")), F.lit(""))


def _offers(batches: DataFrame, own: DataFrame, limit: Column, subscriptions: DataFrame) -> DataFrame:
    """Batches beside what their user held at first (``held`` of ``own``), the cap and the plan; written down."""
    known = with_pro_flag(lookup(batches, own, ["_owner"], costly=True), subscriptions)
    held = F.coalesce("held", F.lit(0).cast("bigint"))
    return materialise(known.withColumns({"held": held, "cap": limit.cast("bigint")}), "offers")


def _settled(decided: DataFrame, batch_key: str) -> DataFrame:
    """(user, batch, held before it, wanted, accepted): accepted sizes are summed over ranges of the batch order."""
    added = F.when(F.col("accepted"), F.col("wanted")).otherwise(F.lit(0).cast("bigint"))
    done = running_total(decided, ["_owner"], ["_batch"], added, "_total")
    before = F.col("held") + F.col("_total") - added
    return done.select("user_id", F.col("_batch").alias(batch_key), before.alias("held"), "wanted", "accepted")


def enforce_limit(
    existing: DataFrame, batch: DataFrame, batch_key: str, limit: Column, subscriptions: DataFrame
) -> DataFrame:
    """Per user, in the order of batches: whether a whole batch still fits, given those accepted before it.

    A refused batch takes nothing up. Active pro users are never refused. Room only shrinks, so once a
    batch of some size is refused all later ones of that size are: the accepted batches of size n are the first ones,
    at most room / n of them. Only those candidates meet in one fold, so its length is bounded by the limit and
    not by the batches of a user; what was held before each batch is a running total over ranges.
    """
    owner = _owner(F.col("user_id")).alias("_owner")
    own = existing.groupBy(owner).agg(F.count(F.lit(1)).alias("held"))
    wanted = batch.groupBy(owner, "user_id", F.col(batch_key).alias("_batch")).agg(F.count(F.lit(1)).alias("wanted"))
    offers = _offers(wanted, own, limit, subscriptions)
    room = F.col("cap") - F.col("held")
    fitting = offers.filter(~F.col("is_pro") & (F.col("wanted") <= room))
    fitting = fitting.withColumn("_slice", F.pmod(F.xxhash64("_batch"), F.lit(SLICES)))
    for keys in (["_owner", "wanted", "_slice"], ["_owner", "wanted"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_batch"))
        fitting = fitting.withColumn("_nth", nth).filter(F.col("_nth") * F.col("wanted") <= room)

    def step(done: Column, b: Column) -> Column:
        fits = done["at"] + b["wanted"] <= F.col("cap")
        return F.when(fits, F.struct(
            (done["at"] + b["wanted"]).alias("at"), F.concat(done["taken"], F.array(F.struct(b["_batch"].alias("_batch")))).alias("taken")
        )).otherwise(done)

    kind = f"array<struct<_batch:{dict(offers.dtypes)['_batch']}>>"
    users = fitting.groupBy("_owner", "held", "cap").agg(F.sort_array(F.collect_list(F.struct("_batch", "wanted"))).alias("batches"))
    start = F.struct(F.col("held").alias("at"), F.array().cast(kind).alias("taken"))
    taken = users.select(F.col("_owner").alias("_of"), F.explode(F.aggregate("batches", start, step, lambda done: done["taken"])).alias("_t"))
    same = (F.col("_owner") == F.col("_of")) & F.col("_batch").eqNullSafe(F.col("_t._batch"))
    accepted = F.col("is_pro") | F.col("_of").isNotNull()
    return _settled(offers.join(taken, same, "left").withColumn("accepted", accepted).drop("_of", "_t"), batch_key)


def _brought_items(sets: DataFrame) -> DataFrame:
    """(_owner, _item) that limited users come to hold, from (_owner, _items, _at, held, cap): distinct sets of new items.

    A set that does not fit never fits later: what others bring takes as much room as it can spare the set. So a set is
    decided once, at its first batch, and accepted if in the end all of it is held. A round folds the first
    sets of every user and leaves only those open that would still fit, of which the first is then accepted; there
    are no more rounds than room, and usually one.
    """
    left = materialise(sets.withColumns({"at": F.col("held"), "own": F.array().cast("array<string>")}), "open-sets")
    out = None

    def new(items: Column, own: Column) -> Column:
        return F.array_except(items, own)

    def step(done: Column, s: Column) -> Column:
        more = new(s["_items"], done["own"])
        fits = done["at"] + F.size(more) <= F.col("cap")
        return F.when(fits, F.struct((done["at"] + F.size(more)).alias("at"), F.concat(done["own"], more).alias("own"))).otherwise(done)

    while not left.isEmpty():
        head = first_rows(left, ["_owner"], [F.col("_at"), F.col("_items")], HEAD_SETS)
        users = head.groupBy("_owner", "held", "cap", "at", "own").agg(F.sort_array(F.collect_list(F.struct("_at", "_items"))).alias("sets"))
        folded = F.aggregate("sets", F.struct(F.col("at").cast("bigint").alias("at"), F.col("own").alias("own")), step)
        state = materialise(users.select("_owner", folded.alias("_s"), F.col("own").alias("_before")), "brought")
        brought = state.select("_owner", F.explode(F.array_except("_s.own", "_before")).alias("_item"))
        out = brought if out is None else out.unionByName(brought)
        moved = lookup(left.drop("at", "own"), state.select("_owner", "_s.at", "_s.own"), ["_owner"])
        more = F.size(new(F.col("_items"), F.col("own")))
        left = materialise(moved.filter((more > 0) & (F.col("at") + more <= F.col("cap"))), "open-sets")
    return left.select("_owner", F.lit("").alias("_item")) if out is None else out


def enforce_new(held: DataFrame, offered: DataFrame, batch_key: str, item: str, limit: Column, subscriptions: DataFrame) -> DataFrame:
    """``enforce_limit`` for batches that name what they bring: only items count that a user does not hold yet.

    What an accepted batch brought is held from then on. Missing items bring nothing. No user's batches meet in one
    task: sets larger than the room are refused by their count, equal sets are decided once, and an item is
    new in the batches up to the first accepted one that names it.
    """
    owner = _owner(F.col("user_id")).alias("_owner")
    name = F.col(item).cast("string").alias("_item")
    own = held.groupBy(owner).agg(F.count(F.lit(1)).alias("held"))
    known = held.select(owner, name).distinct().withColumn("_own", F.lit(True))
    named = offered.select(owner, "user_id", F.struct(F.col(batch_key).alias("_batch")).alias("_at"), name).distinct()
    fresh = F.col("_item").isNotNull() & F.col("_own").isNull()
    rows = materialise(lookup(named, known, ["_owner", "_item"], costly=True).select(*named.columns, fresh.alias("_new")), "offered-items")
    offers = _offers(rows.groupBy("_owner", "user_id", "_at").agg(F.count_if("_new").alias("_size")), own, limit, subscriptions)

    small = offers.filter(~F.col("is_pro") & (F.col("_size") > 0) & (F.col("_size") <= F.col("cap") - F.col("held")))
    sets = rows.filter("_new").join(small.select("_owner", "_at", "held", "cap"), ["_owner", "_at"])
    sets = sets.groupBy("_owner", "_at", "held", "cap").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    sets = sets.groupBy("_owner", "_items", "held", "cap").agg(F.min("_at").alias("_at"))

    got = _brought_items(sets).withColumn("_got", F.lit(True))
    rows = lookup(rows, got, ["_owner", "_item"])
    missing = rows.groupBy("_owner", "_at").agg(F.count_if(F.col("_new") & F.col("_got").isNull()).alias("_missing"))
    fits = F.col("is_pro") | ((F.col("_missing") == 0) & (F.col("held") <= F.col("cap")))
    decided = materialise(offers.join(missing, ["_owner", "_at"]).withColumn("accepted", fits), "decided")
    placed = materialise(rows.filter("_new").join(decided.select("_owner", "_at", "accepted"), ["_owner", "_at"]), "placed-items")
    since = placed.filter("accepted").groupBy("_owner", "_item").agg(F.min("_at").alias("_since"))
    still_new = F.col("_since").isNull() | (F.col("_at") <= F.col("_since"))
    counted = lookup(placed, since, ["_owner", "_item"]).groupBy("_owner", "_at").agg(F.count_if(still_new).alias("wanted"))
    full = decided.join(counted, ["_owner", "_at"], "left").withColumns({"wanted": F.coalesce("wanted", F.lit(0).cast("bigint")), "_batch": F.col("_at._batch")})
    return _settled(full.drop("_at", "_size", "_missing"), batch_key)
