"""Rule matching and the ordered fold against a plain sequential reading of them."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywell.operators import rules
from tallywell.schemas import RULE

TXN = ("id string, user_id bigint, type string, category_id string, account_id string, transfer_to_account_id string, "
       "transfer_id string, notes string, description string, raw_text string, amount decimal(15,2), source string")


def rule(rule_id, priority=50, conditions=None, actions=None, logic="or", user=1, active=True, kind="general",
         target=None, phone=None, prompt=None):
    return (rule_id, user, f"rule {rule_id}", active, priority, prompt, phone, target, kind, logic,
            json.dumps(conditions or {}), json.dumps(actions or {}), None, None)


def txn(i, description="Almuerzo en Restaurante", amount="50000", account="acc-1", source="api", raw="Compraste $50,000", user=1):
    from decimal import Decimal

    return (str(i), user, "expense", "cat-1", account, None, None, None, description, raw, Decimal(amount), source)


def sequential(t, ordered):
    """One transaction through the rules, one rule after the other."""
    keys = [f.split()[0] for f in TXN.split(", ")]
    t, fired = dict(zip(keys, t)), []

    def words(list_, text, logic):
        hits = [w.lower() in (text or "").lower() for w in list_]
        return all(hits) if logic == "and" else any(hits)

    for r in ordered:
        c, a = json.loads(r[10]), json.loads(r[11])
        if "description_contains" in c and not words(c["description_contains"], t["description"], r[9]):
            continue
        if c.get("description_regex") and not re.search(c["description_regex"], t["description"] or "", re.I):
            continue
        if "raw_text_contains" in c and not words(c["raw_text_contains"], t["raw_text"], r[9]):
            continue
        if "amount_between" in c and not c["amount_between"][0] <= t["amount"] <= c["amount_between"][1]:
            continue
        if "amount_equals" in c and (c["amount_equals"] is None or t["amount"] != c["amount_equals"]):
            continue
        if c.get("from_account") and t["account_id"] != c["from_account"]:
            continue
        if "source" in c and t["source"] not in c["source"]:
            continue
        fired.append(r[0])
        t["type"] = a.get("set_type") or t["type"]
        if "set_category" in a:
            t["category_id"] = a["set_category"] or None
        t["account_id"] = a.get("set_account") or t["account_id"]
        link = a.get("link_to_account") or r[7]
        if link:
            t["transfer_to_account_id"] = link
            t["transfer_id"] = hashlib.sha256(f"{t['id']}|{r[0]}".encode()).hexdigest()
        if a.get("add_note"):
            t["notes"] = f"{t['notes']}\n{a['add_note']}" if t["notes"] else a["add_note"]
    return (t["id"], t["type"], t["category_id"], t["account_id"], t["transfer_to_account_id"], t["transfer_id"], t["notes"], fired)


@pytest.fixture(scope="module")
def run(spark):
    def go(txns, rule_rows):
        done = rules.apply_rules(spark.createDataFrame(txns, TXN), spark.createDataFrame(rule_rows, RULE))
        rows = done.select("id", "type", "category_id", "account_id", "transfer_to_account_id", "transfer_id", "notes",
                           F.coalesce(F.transform("applied_rules", lambda a: a["rule_id"]), F.array())).collect()
        return sorted((tuple(r) for r in rows), key=lambda r: int(r[0]))

    return go


def test_conditions(run):
    cases = [
        ({"description_contains": ["restaurante"]}, {}, True),
        ({"description_contains": ["restaurante", "uber"]}, {"logic": "and"}, False),
        ({"description_contains": []}, {}, False),
        ({"description_contains": []}, {"logic": "and"}, True),
        ({"description_regex": "^almuerzo.*"}, {}, True),
        ({"description_regex": ""}, {}, True),
        ({"raw_text_contains": ["COMPRASTE"]}, {}, True),
        ({"amount_between": [10000, 100000]}, {}, True),
        ({"amount_between": [10, 100]}, {}, False),
        ({"amount_equals": 50000}, {}, True),
        ({"amount_equals": None}, {}, False),
        ({"from_account": "acc-1"}, {}, True),
        ({"from_account": "acc-2"}, {}, False),
        ({"source": ["api", "sms"]}, {}, True),
        ({"source": []}, {}, False),
        ({}, {}, True),
        ({"contains_text": ["x"]}, {}, True),
        ({"to_account": "zzz", "category": "zzz"}, {}, True),
        ({"description_contains": ["restaurante"], "amount_equals": 1}, {}, False),
    ]
    for conditions, extra, fits in cases:
        got = run([txn(1)], [rule("a", conditions=conditions, actions={"set_type": "income"}, **extra)])
        assert (got[0][1] == "income") == fits, conditions


def test_lowest_priority_has_the_last_word(run):
    got = run([txn(1)], [rule("a", 90, actions={"set_category": "high", "add_note": "1"}),
                         rule("b", 10, actions={"set_category": "low", "add_note": "2"})])
    assert got[0][2] == "low" and got[0][6] == "1\n2" and got[0][7] == ["a", "b"]


def test_feedback_of_the_account(run):
    pair = [rule("a", 90, actions={"set_account": "acc-9"}), rule("b", 10, {"from_account": "acc-9"}, {"set_type": "income"})]
    assert run([txn(1)], pair)[0][1] == "income"
    late = [rule("a", 10, actions={"set_account": "acc-9"}), rule("b", 90, {"from_account": "acc-9"}, {"set_type": "income"})]
    assert run([txn(1)], late)[0][1] == "expense"


def test_clear_category_and_link(run):
    got = run([txn(1)], [rule("a", actions={"set_category": None}, target="acc-7")])[0]
    assert got[2] is None and got[4] == "acc-7" and len(got[5]) == 64
    stated = run([txn(1)], [rule("a", actions={"link_to_account": "acc-8"}, target="acc-7")])[0]
    assert stated[4] == "acc-8"


def test_other_owner_inactive_and_detection_rules_do_nothing(run):
    got = run([txn(1)], [rule("a", actions={"set_type": "income"}, user=2), rule("b", actions={"set_type": "income"}, active=False),
                         rule("c", actions={"set_type": "income"}, kind="account_detection")])
    assert got[0][1] == "expense" and got[0][7] == []


def test_preview_rows_are_left_alone(spark):
    rows = spark.createDataFrame([txn(1), txn(2)], TXN).withColumn(
        "applied_rules", F.when(F.col("id") == "1", F.expr("array(struct('x' AS rule_id, 'x' AS rule_name, '{}' AS actions))")))
    done = rules.apply_rules(rows, spark.createDataFrame([rule("a", actions={"set_type": "income"})], RULE))
    assert {r.id: r.type for r in done.collect()} == {"1": "expense", "2": "income"}


def test_fold_equals_sequential_application(run):
    draw = random.Random(7)
    for _ in range(3):
        table = []
        for i in range(12):
            conditions = draw.choice([
                {}, {"description_contains": draw.sample(["uber", "pan", "rappi"], 2)}, {"description_regex": "^(uber|pan)"},
                {"amount_between": [10, 60]}, {"amount_equals": 50}, {"from_account": draw.choice(["a", "b", "c"])},
                {"source": ["api"]}, {"raw_text_contains": ["x"]}])
            actions = draw.choice([
                {"set_type": "income"}, {"set_category": None}, {"set_category": f"c{i}"}, {"set_account": draw.choice(["a", "b", "c"])},
                {"add_note": f"n{i}"}, {"link_to_account": "b"}, {}])
            table.append(rule(f"r{i:02d}", draw.choice([10, 50, 90]), conditions, actions, draw.choice(["and", "or"]),
                              target=draw.choice([None, None, "t"])))
        txns = [txn(i, draw.choice(["uber pan", "rappi", "pan", "otro"]), draw.choice(["50", "70", "10"]), draw.choice(["a", "b", "c"]),
                    draw.choice(["api", "sms"]), draw.choice(["x y", "z"])) for i in range(40)]
        ordered = sorted(table, key=lambda r: (-r[4], r[0]))
        assert run(txns, table) == [sequential(t, ordered) for t in txns]


def test_first_fitting_detection_rule_decides(spark):
    table = spark.createDataFrame([
        rule("a", 90, {"raw_text_contains": ["nequi"]}, {}, kind="account_detection"),
        rule("b", 80, {"raw_text_contains": ["nequi"]}, {"set_account": "acc-1"}, kind="account_detection"),
        rule("c", 70, {"amount_equals": 5}, {"set_account": "acc-2"}, kind="account_detection"),
        rule("d", 60, {"raw_text_contains": ["efectivo"]}, {"set_account": "acc-3"}, kind="account_detection")], RULE)
    messages = spark.createDataFrame([(1, 1, "Nequi: x"), (2, 1, "en efectivo"), (3, 1, "nada"), (4, 2, "nequi")], "message_id int, user_id bigint, text string")
    got = {r.message_id: (r.detection_rule_id, r.detected_account_id) for r in rules.detect_accounts(messages, table).collect()}
    assert got == {1: ("a", None), 2: ("d", "acc-3"), 3: (None, None), 4: (None, None)}


def test_unfit_rules_are_refused_and_stop_nobody(spark):
    table = [rule("a", conditions={"description_regex": "("}), rule("b", conditions={"description_regex": "^ok{2}$"}),
             rule("c", conditions={"unknown": 1}), rule("d", conditions={"description_regex": "a{"}), rule("e", conditions={"description_regex": "[[x]"}),
             rule("f", conditions={"description_contains": "uber"}), rule("g", conditions={"amount_between": "x"}), rule("h", conditions={"amount_equals": None}),
             rule("i", conditions={"source": ["api", None]}), rule("j", conditions={"from_account": None})]
    columns = [c.strip().split(" ", 1)[0] for c in RULE.split(", ")]
    broken = list(rule("k"))
    broken[columns.index("conditions")] = "not json"
    listed = list(rule("l"))
    listed[columns.index("actions")] = "[1]"
    rows = spark.createDataFrame([*table, tuple(broken), tuple(listed)], RULE)
    assert {r.rule_id: r.refusal for r in rules.refused_rules(rows).collect()} == {
        "a": "bad pattern", "d": "bad pattern", "e": "bad pattern", "f": "wrong type: description_contains",
        "g": "wrong type: amount_between", "i": "wrong type: source", "k": "unreadable conditions", "l": "unreadable actions",
    }
    txn = spark.createDataFrame([("t", 1, "okk", "x", 5, "api", None)], "id string, user_id bigint, description string, raw_text string, amount int, source string, account_id string")
    txn = txn.withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    assert sorted(r.rule_id for r in rules.match_rules(txn, rows).collect()) == ["b", "c", "j"]


PLAIN = ["", "^Nomina.*", "^(uber|pan)", "^ok{2}$", r"pago\s+a\s+\w+", "[a-z]+", "[^0-9-]x", "[-a]", "[a-]", r"[\d.]+", "(?:abc)+x", "(a|b)?c", "caf[ée]",
         r"\$\d{1,3}(?:\.\d{3})*", "a.*b.*c", r"uber\b", "x{0,3}?", "(uber( eats)?|rappi)", "[.]", "[a-z0-9_]", r"a\-b", "^$", "a|", "ñandú", "a&b"]
REFUSED = ["[a&b]", "(?#note)uber", "(?a)uber", "(?i)a", "(?P<n>a)", "(?<n>a)", "(?=a)b", "(?<!a)b", "(?>a)", r"(a)\1", "a++", "a**", "*a", "(", "a)", "a{", "}", "a]", "[]a]", "[a", "a\\",
           "[[x]", "[a-z&&b]", "[a[b]]", "[z-a]", r"\p{L}", r"\x41", r"\Qa\E", r"[\b]", r"\Aa", "a{3,1}", "a{1,9999}", ".*.*.*.*x", "(a+)+$", "(a|b)*c", "(a|aa)+", "(?:(?:a|b))+",
           r"(\w+\s?)*x", "((a*)b)+", "((a)b)+", "(a{1,2})*", "((a+))*", "x" * 600]


def test_patterns_that_may_run(spark, evaluate):
    """Of the patterns that may run, both engines find the same."""
    from tallywell.functions.patterns import may_run

    assert [p for p, ok in zip(PLAIN + REFUSED, evaluate(may_run, PLAIN + REFUSED), strict=True) if ok] == PLAIN
    draw = random.Random(5)
    tokens = ["a", "b", "ab", ".", "*", "+", "?", "(", ")", "(?:", "|", "[", "]", "[ab]", "[^a]", "-", "{2}", "{1,}", "\\d", "\\w", "\\.", "^", "$", "[a-c]", "\\s", "1", " "]
    made = list({"".join(draw.choice(tokens) for _ in range(draw.randint(1, 8))) for _ in range(3000)})
    allowed = [p for p, ok in zip(made, evaluate(may_run, made), strict=True) if ok]
    assert len(allowed) > 150
    texts = ["", "a", "ab", "abab 1", "b.a-1", "  aab", "c 1 b"]
    pairs = spark.createDataFrame([(p, t) for p in allowed for t in texts], "p string, t string")
    for r in pairs.withColumn("fits", F.rlike("t", "p")).collect():
        assert r.fits == bool(re.search(r.p, r.t)), (r.p, r.t)


def test_no_pattern_ends_the_job(spark):
    table = spark.createDataFrame([rule(f"p{i:02d}", conditions={"description_regex": p}, actions={"add_note": p[:5]}) for i, p in enumerate(REFUSED + PLAIN)], RULE)
    rows = spark.createDataFrame([txn(1, "uber eats x" + "a" * 40 + "!"), txn(2, None)], TXN)
    done = {r.id: [a.rule_id for a in r.applied_rules or []] for r in rules.apply_rules(rows, table).collect()}
    assert {r.rule_id for r in rules.refused_rules(table).collect()} == {f"p{i:02d}" for i in range(len(REFUSED))}
    want = [f"p{i + len(REFUSED):02d}" for i, p in enumerate(PLAIN) if re.search(p, "uber eats x" + "a" * 40 + "!", re.I)]
    assert done["1"] == want and len(want) > 5


def test_patterns_are_literals_and_only_feedback_folds(spark, monkeypatch):
    def plan(table, rows):
        return rules.apply_rules(rows, table)._jdf.queryExecution().optimizedPlan().toString()

    rows = spark.createDataFrame([txn(i) for i in range(4)], TXN)
    plain = [rule(f"r{i}", conditions={"description_regex": f"^alm{i % 3}"}, actions={"set_type": "income"}) for i in range(9)]
    book = rules.rule_book(spark.createDataFrame(plain, RULE))
    assert book.patterns == ("^alm0", "^alm1", "^alm2") and book.small
    found = re.findall(r"\(\?i\)(\^alm\d)", plan(book, rows))
    assert sorted(set(found)) == ["^alm0", "^alm1", "^alm2"] and len(found) == 3  # one literal, so one compile, for each
    fits = [r.applied_rules for r in rules.apply_rules(rows, book).collect()]
    monkeypatch.setattr(rules, "MAX_LITERALS", 2)  # beyond it, patterns are read from the rules
    many = rules.rule_book(spark.createDataFrame(plain, RULE))
    assert many.patterns is None and [r.applied_rules for r in rules.apply_rules(rows, many).collect()] == fits


def test_owners_whose_rules_feed_back(spark):
    sets, asks = {"set_account": "acc-9"}, {"from_account": "acc-1"}
    table = [rule("a", 90, actions=sets, user=1), rule("b", 10, asks, {"set_type": "income"}, user=1),
             rule("a", 10, actions=sets, user=2), rule("b", 90, asks, {"set_type": "income"}, user=2), rule("c", 10, asks, user=3), rule("d", 20, actions=sets, user=4)]
    owners = rules.rules_per_user(spark.createDataFrame(table, RULE), None)
    assert {r.user_id: r.feeds_back for r in owners.collect()} == {1: True, 2: False, 3: False, 4: False}
    done = rules.apply_rules(spark.createDataFrame([txn(u, user=u) for u in (1, 2)], TXN), spark.createDataFrame(table, RULE))
    assert {r.user_id: (r.type, r.account_id) for r in done.collect()} == {1: ("expense", "acc-9"), 2: ("income", "acc-9")}


def test_cache_key_holds_the_owners_context(spark):
    """Owners with other prompts share no entry; a refused result is never a hit."""
    import datetime as dt

    from tallywell.catalog import keyed_messages
    from tallywell.operators import dedup

    table = spark.createDataFrame([rule("a", prompt="uno"), rule("b", prompt="uno"), rule("c", prompt="dos")], RULE)
    table = table.withColumn("user_id", F.when(F.col("rule_id") == "a", 1).when(F.col("rule_id") == "b", 2).otherwise(3).cast("bigint"))
    start = dt.datetime(2024, 1, 1)
    texts = [(i, "api", u, t, "api", start + dt.timedelta(minutes=i), None) for i, (u, t) in enumerate(
        [(1, "20k pan"), (2, "20k pan"), (3, "20k pan"), (3, " 20K pan"), (4, "20k pan"), (1, "pan"), (1, "pan")])]
    rows = spark.createDataFrame(texts, "message_id bigint, channel string, user_id bigint, text string, source string, received_at timestamp_ntz, problem string")
    keyed = keyed_messages(rows, table)
    hits = {r.message_id: r.cache_hit for r in dedup.cache_hits(keyed).collect()}
    assert hits == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_digests(spark):
    table = spark.createDataFrame([
        rule("a", 90, {"description_contains": ["x", "y"], "amount_between": [1, 2.5]}, {"set_type": "income"}, "and"),
        rule("b", 10, {"source": ["api"]}, {"set_category": "c"}), rule("c", 50, {}, {"set_category": "c"}),
        rule("d", 70, phone="31", kind="transfer"), rule("e", 80, phone="32", kind="transfer"), rule("f", prompt="uno"), rule("g", prompt="")], RULE)
    text = rules.rule_digest(table).head().rule_digest.split("\n")
    assert text[1] == '- RULE "rule a" (AND): IF description contains [x, y] AND amount between 1-2.5 THEN type→"income"'
    assert text[2] == '- RULE "rule b" (OR): IF source is [api] THEN category→"c"' and len(text) == 4
    assert "Known phones: *32→transfer, *31→transfer." in rules.transfer_digest(table).head().transfer_digest
    assert rules.active_prompts(table).head().prompts == ["uno"]


def test_account_rules(spark):
    accounts = spark.createDataFrame([("1", 1, "A", "savings", "bancolombia", "2651", True), ("2", 1, "B", "cash", "cash", None, True),
                                      ("3", 1, "C", "savings", None, "11", True), ("4", 1, "D", "savings", None, "", True), ("5", 1, "E", "savings", "x", None, False)],
                                     "account_id string, user_id bigint, name string, type string, institution string, last_four string, is_active boolean")
    made = {r.name: (r.conditions, r.actions) for r in rules.account_rules(accounts).collect()}
    assert made == {"Account: A": ('{"raw_text_contains":["bancolombia","2651"]}', '{"set_account":"1"}'),
                    "Account: C": ('{"raw_text_contains":["11"]}', '{"set_account":"3"}')}
