"""User-authored rules: matching, ordered application, account detection, digests.

Rules are data. A user's rules are few and hand-written, so they travel as one array per
user, joined to the facts by user; matching and the ordered fold then run inside the row
with higher-order functions, and no transaction-by-rule pairs are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fv
from tallywell.functions.patterns import may_run
from tallywell.operators.parse import strip_fence
from tallywell.operators.resolve import live
from tallywell.plans.once import once
from tallywell.plans.skew import BROADCAST_BYTES, BROADCAST_RULES, lookup
from tallywell.schemas import ACTIONS, APPLIED_RULES, CONDITIONS, GENERATED_RULE
from tallywell.session import materialise

CONDITIONS_BY_NAME = dict(field.strip().split(" ", 1) for field in CONDITIONS.split(", "))


def typed_rules(rules: DataFrame) -> DataFrame:
    """Parse the JSON documents, once, and note the two keys whose presence matters.

    ``amount_equals`` and ``set_category`` tell an absent key from a JSON null.
    """
    def has(keys: str, key: str) -> Column:
        return F.coalesce(F.array_contains(keys, key), F.lit(False))

    parsed = once(
        rules,
        {
            "cond": F.from_json("conditions", CONDITIONS),
            "act": F.from_json("actions", ACTIONS),
            "cond_keys": F.json_object_keys("conditions"),
            "act_keys": F.json_object_keys("actions"),
            "logic": F.coalesce("condition_logic", F.lit("or")),
        },
    )
    return parsed.withColumns({"has_amount_equals": has("cond_keys", "amount_equals"), "has_set_category": has("act_keys", "set_category")})


#: The conditions that are looked at; others are unknown keys, which fit everything.
EVALUATED = ["description_contains", "description_regex", "raw_text_contains", "amount_between", "amount_equals",
             "from_account", "source"]


def with_refusal(typed: DataFrame) -> DataFrame:
    """Add ``refusal`` to typed rules: why a rule must not run, NULL where it may.

    Conditions or actions that are no JSON object, an evaluated condition of the wrong type,
    which would else read as absent and fit everything, and a pattern that would end the job.
    A JSON null counts as absent.
    """
    def unreadable(column: str, keys: str) -> Column:
        return F.col(column).isNotNull() & F.col(keys).isNull()

    def wrong(key: str) -> Column:
        value = F.col(f"cond.{key}")
        kind = CONDITIONS_BY_NAME[key]
        holes = F.exists(value, lambda v: v.isNull()) if kind.startswith("array") else F.lit(False)
        stated = F.array_contains("cond_keys", key) & F.get_json_object("conditions", f"$.{key}").isNotNull()
        return F.coalesce(stated, F.lit(False)) & (value.isNull() | holes)

    reason = F.when(unreadable("conditions", "cond_keys"), "unreadable conditions").when(unreadable("actions", "act_keys"), "unreadable actions")
    for key in EVALUATED:
        reason = reason.when(wrong(key), f"wrong type: {key}")
    return typed.withColumn("refusal", reason.when(~may_run(F.col("cond.description_regex")), "bad pattern"))


#: More distinct patterns than these are read from the rules as they come, compiled whenever the pattern changes.
MAX_LITERALS = 200


@dataclass(frozen=True)
class RuleBook:
    """A rule table judged and parsed once, for all that reads it."""

    table: DataFrame  # as given
    judged: DataFrame  # live rules, parsed, with the refusal of those that may not run
    small: bool  # few and light enough to be broadcast
    patterns: tuple[str, ...] | None  # the distinct patterns, each compiled once, where they are few

    @property
    def sound(self) -> DataFrame:
        return self.judged.filter(F.col("refusal").isNull()).drop("refusal")


def rule_book(rules: DataFrame | RuleBook, keep: bool = False) -> RuleBook:
    """Judge and parse a rule table; one look at it tells its size and its patterns. ``keep`` writes table and result down."""
    if isinstance(rules, RuleBook):
        return rules
    if keep:
        rules = materialise(rules, "rules")
    judged = with_refusal(typed_rules(live(rules)))
    if keep:
        judged = materialise(judged, "judged-rules")
    text = ["conditions", "actions", "name", "prompt_text"]
    pattern = F.when(F.col("refusal").isNull(), F.nullif(F.col("cond.description_regex"), F.lit("")))
    seen = judged.limit(BROADCAST_RULES + 1).agg(
        F.count("*").alias("n"),
        F.sum(F.length(F.concat_ws("", *text))).alias("characters"),
        F.collect_set(pattern).alias("patterns"),  # of BROADCAST_RULES rules at most
    ).first()
    # a rule stands about three times in its owner's array: as JSON, parsed, and in lower case; a character has four bytes at most
    small = seen["n"] <= BROADCAST_RULES and 12 * (seen["characters"] or 0) <= BROADCAST_BYTES
    patterns = tuple(sorted(seen["patterns"]))
    return RuleBook(rules, judged, small, patterns if small and len(patterns) <= MAX_LITERALS else None)


def refused_rules(rules: DataFrame | RuleBook) -> DataFrame:
    """The live rules that do not run, for their owners to mend."""
    judged = rules.judged if isinstance(rules, RuleBook) else with_refusal(typed_rules(live(rules)))
    return judged.filter(F.col("refusal").isNotNull()).select("rule_id", "user_id", "name", "refusal")


def _keywords_hold(words: Column, lowered: Column, logic: Column) -> Column:
    """any/all of the words in the text, both in lower case; of no words, any is false, all true."""
    def inside(word: Column) -> Column:
        return F.contains(lowered, word)

    some = F.when(logic == "and", F.forall(words, inside)).otherwise(F.exists(words, inside))
    return words.isNull() | some


def _with_lowered(df: DataFrame, description: Column, raw_text: Column) -> DataFrame:
    """The two searched texts in lower case, once per row instead of once per keyword."""
    return df.withColumns(
        {
            "_low_description": F.lower(F.coalesce(description, F.lit(""))),
            "_low_raw_text": F.lower(F.coalesce(raw_text, F.lit(""))),
        }
    )


def _fits_pattern(rule: Column, description: Column, patterns: tuple[str, ...] | None) -> Column:
    """Whether the description holds the rule's pattern; of no pattern true.

    Patterns that are known are literals, each compiled once for a task. A rule names its own by number, and only that
    branch is looked at.
    """
    text = F.coalesce(description, F.lit(""))
    if patterns is None:
        pattern = F.coalesce(rule.getField("cond").getField("description_regex"), F.lit(""))
        return F.when(pattern == "", F.lit(True)).otherwise(F.rlike(text, F.concat(F.lit("(?i)"), pattern)))
    fits = F.when(rule.getField("pattern_no") == 0, F.lit(True))
    for number, pattern in enumerate(patterns, start=1):
        fits = fits.when(rule.getField("pattern_no") == number, F.rlike(text, F.lit(f"(?i){pattern}")))
    return fits.otherwise(F.lit(False))


def conditions_hold(
    rule: Column, description: Column, amount: Column, source: Column, patterns: tuple[str, ...] | None = None
) -> Column:
    """Whether one typed rule fits the record, but for its ``from_account``. All stated conditions must hold.

    Reads the lower-case texts that ``_with_lowered`` adds to the row. Cheap conditions come first, the pattern last.

    No condition, or only unknown ones, fits everything. ``to_account`` and ``category`` are
    accepted in rules but never looked at.
    """
    cond = rule.getField("cond")

    def part(name: str) -> Column:
        return cond.getField(name)

    low, high = F.get(part("amount_between"), F.lit(0)), F.get(part("amount_between"), F.lit(1))
    outside = F.coalesce(amount < low, F.lit(False)) | F.coalesce(amount > high, F.lit(False))
    return (
        (part("amount_between").isNull() | (amount.isNotNull() & ~outside))
        & (~rule.getField("has_amount_equals") | F.coalesce(amount == part("amount_equals"), F.lit(False)))
        & (part("source").isNull() | F.coalesce(F.array_contains(part("source"), source), F.lit(False)))
        & _keywords_hold(rule.getField("description_words"), F.col("_low_description"), rule.getField("logic"))
        & _keywords_hold(rule.getField("raw_text_words"), F.col("_low_raw_text"), rule.getField("logic"))
        & _fits_pattern(rule, description, patterns)
    )


def _asks_no_other(rule: Column, account_id: Column) -> Column:
    """Whether the rule asks for no account, or for this one."""
    asked = rule.getField("cond").getField("from_account")
    return (F.coalesce(asked, F.lit("")) == "") | F.coalesce(account_id == asked, F.lit(False))


FOLDED = ["type", "category_id", "account_id", "transfer_to_account_id", "transfer_id", "notes"]
RULE_FIELDS = ["rule_id", "name", "priority", "transfer_to_account_id", "actions",
               "cond", "act", "has_amount_equals", "has_set_category", "logic",
               "description_words", "raw_text_words", "pattern_no"]


def rules_per_user(rules: DataFrame | RuleBook, rule_types: list[str] | None, out: str = "rules") -> DataFrame:
    """Per user the live rules that may run as an array, highest priority first, ties by rule id.

    ``feeds_back`` tells whether a rule asks for an account after one that sets the account.
    """
    book = rule_book(rules)
    chosen = book.sound
    if rule_types is not None:
        chosen = chosen.filter(F.col("rule_type").isin(*rule_types))
    else:
        chosen = chosen.filter(~F.col("rule_type").eqNullSafe(F.lit("account_detection")))
    pattern = F.coalesce("cond.description_regex", F.lit(""))
    known = F.array_position(F.array(*map(F.lit, book.patterns)), pattern) if book.patterns else F.lit(0)
    typed = chosen.withColumns(
        {
            "description_words": F.transform("cond.description_contains", F.lower),
            "raw_text_words": F.transform("cond.raw_text_contains", F.lower),
            "pattern_no": F.when(pattern == "", F.lit(0)).otherwise(known).cast("int"),
        }
    )
    payload = F.struct(*[F.col(f) for f in RULE_FIELDS]).alias("rule")
    entry = F.struct((-F.col("priority")).alias("rank"), F.col("rule_id"), payload)
    grouped = once(typed.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias(out)), {out: F.transform(out, lambda e: e["rule"])})
    places = F.transform(F.col(out), lambda r, i: F.struct(
        F.when(F.coalesce(r["act"]["set_account"], F.lit("")) != "", i).alias("sets"),
        F.when(F.coalesce(r["cond"]["from_account"], F.lit("")) != "", i).alias("asks"),
    ))
    first_set, last_asked = F.array_min(F.transform(places, lambda p: p["sets"])), F.array_max(F.transform(places, lambda p: p["asks"]))
    return grouped.withColumn("feeds_back", F.coalesce(first_set < last_asked, F.lit(False)))


def _with_fits(joined: DataFrame, book: RuleBook, rules_column: Column) -> DataFrame:
    """Add ``_fits``: one flag per rule of the row's owner, looking at the record as it came in but for the account."""
    lowered = _with_lowered(joined, F.col("description"), F.col("raw_text"))
    flags = F.transform(
        rules_column,
        lambda r: conditions_hold(r, F.col("description"), F.col("amount"), F.col("source"), book.patterns),
    )
    return once(lowered, {"_fits": flags}).drop("_low_description", "_low_raw_text")


def match_rules(transactions: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """One row per (transaction, fitting rule), looking at the record as it came in."""
    book = rule_book(rules)
    joined = lookup(transactions, rules_per_user(book, None), ["user_id"], "inner", book.small, costly=True)
    fitting = F.filter("rules", lambda r, i: F.get("_fits", i) & _asks_no_other(r, F.col("account_id")))
    return _with_fits(joined, book, F.col("rules")).select(
        *transactions.columns, F.explode(fitting).alias("rule")
    ).select(*transactions.columns, "rule.rule_id", "rule.name", "rule.priority")


def _through_accounts(start: Column) -> Column:
    """The flags of the rules, where a rule's ``from_account`` sees the account as earlier rules left it."""
    seen = F.struct(start.alias("account"), F.array().cast("array<boolean>").alias("fits"))
    asked = F.transform("rules", lambda r, i: F.struct(r.alias("rule"), F.get("_fits", i).alias("fits")))

    def step(acc: Column, item: Column) -> Column:
        fits = item["fits"] & _asks_no_other(item["rule"], acc["account"])
        stated = F.nullif(item["rule"]["act"]["set_account"], F.lit(""))
        return F.struct(
            F.when(fits, F.coalesce(stated, acc["account"])).otherwise(acc["account"]).alias("account"),
            F.concat(acc["fits"], F.array(fits)).alias("fits"),
        )

    return F.aggregate(asked, seen, step)["fits"]


def apply_rules(transactions: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """Run each user's rules over each transaction in priority order.

    Highest priority first, so for type, category and account the lowest fitting rule has
    the last word, and notes pile up in order. A rule's ``from_account`` sees the account as
    earlier rules left it. Rows whose ``applied_rules`` is already set are left alone.

    A row gets one flag per rule, and each field the value of the last flagged rule that states
    it. Only rows of owners whose rules feed back (one asks for an account after one that sets
    it) walk the rules in order, and only for the account.

    Needs id, user_id, type, category_id, account_id, transfer_to_account_id, transfer_id,
    notes, description, raw_text, amount, source; ``applied_rules`` is optional.
    """
    book = rule_book(rules)
    carried = [c for c in transactions.columns if c != "applied_rules"]
    joined = lookup(transactions, rules_per_user(book, None), ["user_id"], known_small=book.small, costly=True)
    earlier = (
        F.col("applied_rules")
        if "applied_rules" in transactions.columns
        else F.lit(None).cast(APPLIED_RULES)
    )
    marked = _with_fits(joined, book, F.when(earlier.isNull(), F.col("rules")))
    account = F.col("account_id").cast("string")
    as_it_came = F.transform("rules", lambda r, i: F.get("_fits", i) & _asks_no_other(r, account))
    flags = F.when(F.col("feeds_back"), _through_accounts(account)).otherwise(as_it_came)
    # no flags (no rules, or rules already applied) flag no rule and keep the record
    marked = once(marked, {"_fits": F.when(F.col("_fits").isNotNull(), flags)})
    marked = once(marked, {"_fired": F.filter("rules", lambda r, i: F.coalesce(F.get("_fits", i), F.lit(False)))})

    def last(value, states=None) -> Column:
        """struct(value) of the last fired rule that states it."""
        stating = F.filter("_fired", states or (lambda r: value(r).isNotNull()))
        given = F.transform(stating, lambda r: F.struct(value(r).alias("value"), r["rule_id"].alias("rule_id")))
        return F.try_element_at(given, F.lit(-1))

    def act(name: str):
        return lambda r: F.nullif(r["act"][name], F.lit(""))

    def link(r: Column) -> Column:
        return F.coalesce(act("link_to_account")(r), F.nullif(r["transfer_to_account_id"], F.lit("")))

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    category = last(act("set_category"), lambda r: r["has_set_category"])
    linked = last(link)
    added = F.filter(F.transform("_fired", act("add_note")), lambda n: n.isNotNull())
    notes = F.concat(F.filter(F.array(text("notes")), lambda n: F.coalesce(n, F.lit("")) != ""), added)
    new = {
        "type": F.coalesce(last(act("set_type"))["value"], text("type")),
        "category_id": F.when(category.isNotNull(), category["value"]).otherwise(text("category_id")),
        "account_id": F.coalesce(last(act("set_account"))["value"], account),
        "transfer_to_account_id": F.coalesce(linked["value"], text("transfer_to_account_id")),
        "transfer_id": F.when(linked.isNotNull(), F.sha2(F.concat_ws("|", F.col("id"), linked["rule_id"]), 256)).otherwise(text("transfer_id")),
        "notes": F.when(F.size(added) > 0, F.array_join(notes, "\n")).otherwise(text("notes")),
    }
    named = F.transform("_fired", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["name"].alias("rule_name"), r["actions"].alias("actions")))
    applied = F.when(earlier.isNotNull(), earlier).when(F.size("_fired") > 0, named)
    return marked.select(*[new[c].alias(c) if c in FOLDED else F.col(c) for c in carried], applied.alias("applied_rules"))


def override_flags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which of type, category and account the rules changed, per transaction id."""
    fields = ["type", "category_id", "account_id"]
    old = before.select("id", *[F.col(f).alias(f"parsed_{f}") for f in fields])
    flags = [(~F.col(f).eqNullSafe(F.col(f"parsed_{f}"))).alias(f"{f}_changed") for f in fields]
    return after.join(old, "id").select("id", *fields, *[f"parsed_{f}" for f in fields], *flags)


# -- account detection -------------------------------------------------------------------
def detect_accounts(messages: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """Add the first fitting account-detection rule and the account it sets.

    Detection sees the raw text alone. The first fitting rule decides even where it sets no
    account.
    """
    book = rule_book(rules)
    per_user = rules_per_user(book, ["account_detection"], "detection_rules").drop("feeds_back")
    nothing = F.lit(None)
    fitting = F.filter(
        "detection_rules",
        lambda r: conditions_hold(
            r, nothing.cast("string"), nothing.cast("decimal(15,2)"), nothing.cast("string"), book.patterns
        ) & _asks_no_other(r, nothing.cast("string")),
    )
    first = F.get(fitting, F.lit(0))
    joined = lookup(messages, per_user, ["user_id"], known_small=book.small, costly=True)
    return (
        _with_lowered(joined, nothing.cast("string"), F.col("text"))
        .withColumn("_rule", first)
        .withColumns(
            {
                "detection_rule_id": F.col("_rule.rule_id"),
                "detection_rule_name": F.col("_rule.name"),
                "detected_account_id": F.nullif(F.col("_rule.act.set_account"), F.lit("")),
            }
        )
        .drop("_rule", "detection_rules", "_low_description", "_low_raw_text")
    )


def rule_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts a detection rule can be made for: active, not cash, with something to look for."""
    stated = F.concat(
        F.coalesce("institution", F.lit("")), F.coalesce("last_four", F.lit(""))
    )
    return accounts.filter(
        (F.col("type") != "cash") & (F.col("is_active") == F.lit(True)) & (stated != "")
    )


def account_rules(accounts: DataFrame) -> DataFrame:
    """A detection rule per suitable account, looking for its institution and last four digits."""
    keywords = F.filter(
        F.array("institution", "last_four"), lambda k: F.coalesce(k, F.lit("")) != ""
    )
    return rule_accounts(accounts).select(
        F.sha2(F.concat_ws("|", F.lit("account-rule"), "account_id"), 256).alias("rule_id"),
        "user_id",
        F.concat(F.lit("Account: "), "name").alias("name"),
        F.lit(True).alias("is_active"),
        F.lit(fv.ACCOUNT_RULE_PRIORITY).alias("priority"),
        F.lit("account_detection").alias("rule_type"),
        F.lit("and").alias("condition_logic"),
        F.to_json(F.struct(keywords.alias("raw_text_contains"))).alias("conditions"),
        F.to_json(F.struct(F.col("account_id").alias("set_account"))).alias("actions"),
    )


def accounts_without_rule(accounts: DataFrame, rules: DataFrame) -> DataFrame:
    """Suitable accounts that no live detection rule sets."""
    covered = (
        live(rules)
        .filter(F.col("rule_type") == "account_detection")
        .select("user_id", F.get_json_object("actions", "$.set_account").alias("account_id"))
        .filter(F.col("account_id").isNotNull())
        .distinct()
    )
    return rule_accounts(accounts).join(covered, ["user_id", "account_id"], "left_anti")


def normalise_generated(documents: DataFrame, column: str) -> DataFrame:
    """Rule rows, with defaults, from JSON arrays of rules (a markdown fence is allowed).

    Empty name, type and logic default like missing ones; priority 0 stays.
    """
    clean = strip_fence(F.col(column))
    rule = F.explode(F.from_json(clean, f"array<struct<{_colons(GENERATED_RULE)}>>"))
    keep = [c for c in documents.columns if c != column]
    exploded = documents.select(*keep, rule.alias("rule")).select(*keep, "rule.*")

    texts = {
        name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))
        for name, value in fv.RULE_DEFAULTS.items()
    }
    return exploded.withColumns(
        {
            **texts,
            "is_active": F.coalesce("is_active", F.lit(True)),
            "priority": F.coalesce("priority", F.lit(fv.DEFAULT_PRIORITY)),
        }
    )


def _colons(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (field.split(" ", 1) for field in ddl.split(", ")))


# -- digests -----------------------------------------------------------------------------
def phone_rules(rules: DataFrame) -> DataFrame:
    """Live rules with a phone to match."""
    return live(rules).filter(F.col("match_phone").isNotNull())


def prompted_rules(rules: DataFrame) -> DataFrame:
    """Live rules with a prompt."""
    return live(rules).filter(F.length("prompt_text") > 0)


def _lines_per_user(rules: DataFrame, line: Column, out: str) -> DataFrame:
    """Per user the non-empty lines in rule order."""
    entry = F.struct((-F.col("priority")).alias("rank"), F.col("rule_id"), line.alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["line"])
    return rules.groupBy("user_id").agg(F.filter(ordered, lambda x: x != "").alias(out))


def transfer_digest(rules: DataFrame) -> DataFrame:
    """Per user the sentence that lists the phones with a transfer rule; '' without any."""
    line = F.concat(F.lit("*"), "match_phone", F.lit("→transfer"))
    lists = _lines_per_user(phone_rules(rules).filter(F.col("match_phone") != ""), line, "phones")
    sentence = F.concat(
        F.lit(fv.TRANSFER_DIGEST_HEAD), F.array_join("phones", ", "), F.lit(fv.TRANSFER_DIGEST_TAIL)
    )
    return lists.select(
        "user_id", F.when(F.size("phones") > 0, sentence).otherwise("").alias("transfer_digest")
    )


def _number(value: Column) -> Column:
    """A number the way JSON shows it: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def rule_digest(rules: DataFrame) -> DataFrame:
    """Per user one line per rule that sets a type or category under stated conditions."""
    typed = typed_rules(live(rules).filter(~F.col("rule_type").eqNullSafe(F.lit("account_detection"))))

    def cond(name: str) -> Column:
        return F.col(f"cond.{name}")

    def act(name: str) -> Column:
        return F.nullif(F.col(f"act.{name}"), F.lit(""))

    actionable = typed.filter(
        (act("set_type").isNotNull() | act("set_category").isNotNull() | act("link_to_account").isNotNull())
        & (F.coalesce("match_phone", F.lit("")) == "")
    )

    def listed(name: str, label: str) -> Column:
        words = F.array_join(cond(name), ", ")
        return F.when(F.size(cond(name)) > 0, F.concat(F.lit(f"{label} ["), words, F.lit("]")))

    between = cond("amount_between")
    parts = F.array_compact(
        F.array(
            listed("description_contains", "description contains"),
            F.when(
                F.coalesce(cond("description_regex"), F.lit("")) != "",
                F.concat(F.lit("description matches /"), cond("description_regex"), F.lit("/")),
            ),
            F.concat(
                F.lit("amount between "), _number(F.get(between, F.lit(0))),
                F.lit("-"), _number(F.get(between, F.lit(1))),
            ),
            listed("source", "source is"),
        )
    )
    effects = F.array_compact(
        F.array(
            F.concat(F.lit('type→"'), act("set_type"), F.lit('"')),
            F.concat(F.lit('category→"'), act("set_category"), F.lit('"')),
        )
    )
    joined_parts = F.when(F.col("logic") == "and", F.array_join(parts, " AND ")).otherwise(
        F.array_join(parts, " OR ")
    )
    line = F.when(
        (F.size(parts) > 0) & (F.size(effects) > 0),
        F.concat(
            F.lit('- RULE "'), "name", F.lit('" ('), F.upper("logic"), F.lit("): IF "),
            joined_parts, F.lit(" THEN "), F.array_join(effects, ", "),
        ),
    ).otherwise("")
    lists = _lines_per_user(actionable, line, "lines")
    text = F.concat(
        F.lit(fv.RULE_DIGEST_HEAD), F.array_join("lines", "\n"), F.lit(fv.RULE_DIGEST_TAIL)
    )
    return lists.select("user_id", F.when(F.size("lines") > 0, text).otherwise("").alias("rule_digest"))


def active_prompts(rules: DataFrame) -> DataFrame:
    """Per user the rule prompts in rule order."""
    return _lines_per_user(prompted_rules(rules), F.col("prompt_text"), "prompts")


def _owner_context(rules: DataFrame) -> DataFrame:
    """Per user the sections that do not depend on the message: each prompt, transfer digest, rule digest."""
    per_user = (
        rules.select("user_id")
        .distinct()
        .join(active_prompts(rules), "user_id", "left")
        .join(transfer_digest(rules), "user_id", "left")
        .join(rule_digest(rules), "user_id", "left")
    )
    every = F.concat(F.coalesce("prompts", F.array().cast("array<string>")), F.array("transfer_digest", "rule_digest"))
    stated = F.filter(every, lambda s: F.coalesce(s, F.lit("")) != "")
    return per_user.select("user_id", stated.alias("owner_sections"))


def _with_owner_context(messages: DataFrame, book: RuleBook, owners: DataFrame) -> DataFrame:
    """The detected messages with their owner's columns, and ``hint``: the account section."""
    before, between, after = (F.lit(part) for part in fv.ACCOUNT_HINT)
    hint = F.concat(before, "detection_rule_name", between, "detected_account_id", after)
    joined = lookup(detect_accounts(messages, book), owners, ["user_id"], known_small=book.small, costly=True)
    return joined.withColumn("hint", F.nullif(hint, F.lit("")))


def context_sections(messages: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """Add ``sections``: account hint, each prompt, transfer digest and rule digest, as far as there are any."""
    book = rule_book(rules)
    joined = _with_owner_context(messages, book, _owner_context(book.table))
    stated = F.concat(F.filter(F.array("hint"), lambda s: s.isNotNull()), F.coalesce("owner_sections", F.array().cast("array<string>")))
    return joined.withColumn("sections", stated).drop("owner_sections", "hint")


def context_json(messages: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """Add ``context``: the sections as a JSON array, NULL without any; an owner's own part is written once per owner."""
    book = rule_book(rules)
    inner = lambda sections: F.nullif(F.regexp_replace(F.to_json(sections), r"^\[|\]$", ""), F.lit(""))
    owners = _owner_context(book.table).select("user_id", inner(F.col("owner_sections")).alias("owner_context"))
    joined = _with_owner_context(messages, book, owners)
    hint = F.when(F.col("hint").isNotNull(), inner(F.array("hint")))
    every = F.nullif(F.concat_ws(",", hint, "owner_context"), F.lit(""))
    return joined.withColumn("context", F.concat(F.lit("["), every, F.lit("]"))).drop("owner_context", "hint")


def parse_context(messages: DataFrame, rules: DataFrame | RuleBook) -> DataFrame:
    """Add ``context``: the sections by blank lines."""
    return context_sections(messages, rules).withColumn("context", F.array_join("sections", "\n\n")).drop("sections")
