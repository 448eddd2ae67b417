"""Common table expressions the oracle statements are put together from."""

from __future__ import annotations

import re

from tallywell import fixed_values as fv
from tallywell.functions import parse as p
from tallywell.sources.staging import RULE_COLUMNS, RULE_TEMPLATES, STAGING


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def staged(view: str) -> str:
    sql = re.sub(r"\{(\w+)\}", r"\1", STAGING[view]).replace("`", '"')
    return f"{view} AS ({sql})"


def g1(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


def first(text: str, patterns, group: int = 1) -> str:
    return "coalesce(" + ", ".join(g1(text, x, group) for x in patterns) + ")"


def fold(text: str) -> str:
    return f"translate(lower({text}), 'áéíóúüñ', 'aeiouun')"


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def pad2(text: str) -> str:
    return f"CASE WHEN length({text}) < 2 THEN lpad({text}, 2, '0') ELSE {text} END"


def wide_trim(text: str) -> str:
    w = fv.WIDE_SPACE
    return f"regexp_replace({text}, {q(f'^{w}+|{w}+$')}, '', 'g')"


# -- messages ----------------------------------------------------------------------------
EXCERPT = f"""
CASE WHEN {first('payload', fv.EMAIL_PATTERNS, 0)} IS NOT NULL
  THEN split_part(substring(payload, CAST(instr(payload, {first('payload', fv.EMAIL_PATTERNS, 0)}) AS INT), 200), chr(10), 1)
  ELSE {wide_trim("list_filter(string_split(payload, chr(10)), lambda l: contains(lower(l), 'bancolombia') AND regexp_matches(l, '[0-9,.]+'))[1]")} END"""
COMMAND = r"^/(?:gasto|expense)(?:@\S+)?(?:\s|$)"
SERVICE = r"^/(?:start|help)(?:@\S+)?(?:\s|$)"

SHAPED = f"""
paid AS (
  SELECT *, CASE WHEN channel = 'email'
    THEN coalesce(nullif(body, ''), nullif(text, ''), nullif(subject, ''), '') END AS payload FROM message),
cut AS (
  SELECT message_id, channel, user_id, received_at, payload, source AS given,
    CASE WHEN channel = 'email' THEN nullif({EXCERPT}, '')
      WHEN channel = 'chat' AND regexp_matches(text, {q(COMMAND)})
        THEN CASE WHEN contains(text, ' ') THEN substring(text, CAST(instr(text, ' ') AS INT) + 1) ELSE '' END
      ELSE text END AS text
  FROM paid),
shaped AS (
  SELECT message_id, channel, user_id, text, received_at,
    CASE channel WHEN 'email' THEN 'bancolombia_email' WHEN 'bulk' THEN 'sms-bulk' WHEN 'chat' THEN NULL
      ELSE coalesce(given, 'api') END AS source,
    CASE WHEN channel = 'email' AND NOT contains(lower(payload), 'bancolombia') THEN 'not_bancolombia'
      WHEN channel = 'email' AND text IS NULL THEN 'no_text_extracted'
      WHEN channel = 'chat' AND regexp_matches(text, {q(SERVICE)}) THEN 'Service command'
      WHEN coalesce(text, '') = '' THEN 'Missing text' END AS problem
  FROM cut)"""


def _skip() -> str:
    tests = {name: has("f", words) for name, words in fv.SKIP_PHRASES}
    for name, (_, pattern) in fv.SKIP_PATTERNS.items():
        tests[name] += f" OR regexp_matches(f, {q(pattern)})"
    whens = " ".join(f"WHEN {test} THEN {q(name)}" for name, test in tests.items())
    skipped = f"CASE {whens} WHEN regexp_matches(f, {q(fv.REMINDER)}) THEN 'informational' END"
    return (
        f"CASE WHEN regexp_matches(f, {q(fv.SUMMARY)}) THEN 'spending_summary' "
        f"WHEN NOT regexp_matches(f, {q(fv.DONE_WITH_AMOUNT)}) THEN {skipped} END"
    )


def _thousands(d: str) -> str:
    return (
        f"TRY_CAST(1000 * CASE WHEN regexp_matches({d}, '^\\d+[.,]\\d{{1,2}}$') THEN TRY_CAST(replace({d}, ',', '.') AS DECIMAL(15,2)) "
        f"ELSE TRY_CAST(regexp_replace({d}, '[.,]', '', 'g') AS DECIMAL(15,2)) END AS DECIMAL(15,2))"
    )


def _whole(d: str) -> str:
    cents = r"[.,](\d{2})[.,]?$"
    return (
        f"TRY_CAST(regexp_replace(regexp_replace({d}, {q(cents)}, ''), '[.,]', '', 'g') || '.' || "
        f"coalesce({g1(d, cents)}, '00') AS DECIMAL(15,2))"
    )


MONTH_LIST = "[" + ", ".join(q(m) for m in fv.MONTH_WORDS) + "]"
DAY_LIST = "[" + ", ".join(q(d) for d in fv.WEEKDAY_WORDS) + "]"
WORDS = "MAP {" + ", ".join(f"{q(w)}: {q(s)}" for w, s in p.WORD_TO_SLUG.items()) + "}"
TODAY = "CAST(received_at - INTERVAL 5 HOUR AS DATE)"


def category(text: str) -> str:
    words = f"regexp_extract_all({fold(text)}, {q(p.ANY_WORD)}, 1)"
    longest = f"list_sort(list_transform({words}, lambda w: {{'n': length(w), 'w': w}}), 'DESC')[1].w"
    return f"coalesce(({WORDS})[{longest}], 'missing')"


SLASH = "strftime({}, '%d/%m/%Y')"
PHONE = first("text", fv.PHONE_PATTERNS)
ORIGIN = first("text", fv.ORIGIN_ACCOUNT_PATTERNS)

PARSED = f"""
caught AS (
  SELECT *, {fold('text')} AS f, {TODAY} AS today FROM shaped WHERE problem IS NULL),
captured AS (
  SELECT *, {_skip()} AS skip_reason,
    {g1('text', p.SIGNED_AMOUNT)} AS a1, {g1('text', p.SIGNED_AMOUNT, 2)} AS a2,
    {g1('text', p.SUFFIXED_AMOUNT)} AS a3,
    {g1(f"regexp_replace(f, {q(p.NOT_AN_AMOUNT)}, ' ', 'g')", p.BARE_AMOUNT)} AS a4,
    coalesce({g1('f', r'(\d{1,2}/\d{1,2}/\d{4})')}, {g1('f', r'(\d{4}-\d{2}-\d{2})')}) AS stated,
    {g1('f', p.NAMED_DAY, 1)} AS nd, {g1('f', p.NAMED_DAY, 2)} AS nm, {g1('f', p.NAMED_DAY, 3)} AS ny,
    CASE WHEN contains(f, 'last monday') THEN 'lunes' ELSE {g1('f', p.NAMED_WEEKDAY)} END AS wd,
    {g1('f', p.DAY_OF_MONTH)} AS md,
    CASE WHEN contains(text, 'Bancolombia:') THEN 'bancolombia_email'
      WHEN contains(text, 'Nequi:') OR contains(text, '85954') THEN 'nequi_sms' ELSE 'manual' END AS parsed_source,
    {PHONE} AS phone, {ORIGIN} AS origin_account,
    {has('lower(text)', fv.TRANSFER_KEYWORDS)} AS is_transfer,
    regexp_matches(f, {q(p.CLOCK)}) AS has_clock,
    {g1('f', p.CLOCK, 1)} AS c1, {g1('f', p.CLOCK, 2)} AS c2, {g1('f', p.CLOCK, 3)} AS c3,
    {g1('f', p.HOUR_HALF, 1)} AS h1, {g1('f', p.HOUR_HALF, 2)} AS h2,
    {g1('f', p.HOUR_PART_OF_DAY, 1)} AS d1, {g1('f', p.HOUR_PART_OF_DAY, 2)} AS d2
  FROM caught),
dated AS (
  SELECT *,
    CASE WHEN stated IS NOT NULL THEN stated
      WHEN nm IS NOT NULL THEN {pad2('nd')} || '/' || {pad2(f"CAST(list_position({MONTH_LIST}, nm) AS VARCHAR)")} || '/' || coalesce(ny, CAST(year(today) AS VARCHAR))
      WHEN regexp_matches(f, '\\banteayer\\b|day before yesterday') THEN {SLASH.format('today - 2')}
      WHEN regexp_matches(f, '\\b(?:ayer|yesterday)\\b') THEN {SLASH.format('today - 1')}
      WHEN regexp_matches(f, '\\b(?:hoy|today)\\b') THEN {SLASH.format('today')}
      WHEN wd IS NOT NULL THEN {SLASH.format(f"today - CAST((isodow(today) + 7 - list_position({DAY_LIST}, wd)) % 7 AS INT)")}
      WHEN md IS NOT NULL THEN {pad2('md')} || strftime(today, '/%m/%Y')
      WHEN {has('f', ['esta semana', 'this week', 'este mes', 'this month'])} THEN {SLASH.format('today')} END AS original_date,
    CASE WHEN has_clock THEN c1 WHEN h1 IS NOT NULL THEN h1 ELSE d1 END AS hr,
    CASE WHEN has_clock THEN c3 WHEN h1 IS NOT NULL THEN h2 ELSE d2 END AS half
  FROM captured),
timed AS (
  SELECT *, CASE WHEN half IN ('pm', 'p.m', 'tarde', 'noche') AND CAST(hr AS INT) < 12 THEN CAST(hr AS INT) + 12
      WHEN half IN ('am', 'a.m', 'noche') AND CAST(hr AS INT) = 12 THEN 0 ELSE CAST(hr AS INT) END AS hour24
  FROM dated),
described AS (
  SELECT *,
    CASE WHEN hr IS NOT NULL THEN {pad2('CAST(hour24 AS VARCHAR)')} || ':' || coalesce(CASE WHEN has_clock THEN c2 END, '00')
      WHEN contains(f, 'mediodia') THEN '12:00' WHEN contains(f, 'medianoche') THEN '00:00' END AS original_time,
    skip_reason IS NULL AS is_transaction,
    CASE WHEN skip_reason IS NOT NULL THEN CAST(0 AS DECIMAL(15,2)) WHEN a2 IS NOT NULL THEN {_thousands('a1')}
      WHEN a1 IS NOT NULL THEN {_whole('a1')} WHEN a3 IS NOT NULL THEN {_thousands('a3')} ELSE {_whole('a4')} END AS amount,
    CASE WHEN parsed_source = 'bancolombia_email' OR contains(f, 'bancolombia') AND parsed_source = 'manual' THEN 'bancolombia'
      WHEN parsed_source = 'nequi_sms' OR contains(f, 'nequi') THEN 'nequi'
      WHEN contains(f, 'daviplata') THEN 'daviplata' ELSE 'cash' END AS bank,
    CASE WHEN {has('f', p.DEBIT_WORDS)} THEN 'debit' WHEN {has('f', p.CREDIT_WORDS)} THEN 'credit'
      WHEN parsed_source = 'nequi_sms' THEN 'transfer' WHEN parsed_source = 'bancolombia_email' THEN 'debit' ELSE 'cash' END AS payment_type,
    CASE WHEN {has('f', ['credito de libre inversion', 'prestamo'])} THEN 'credit' WHEN {has('f', p.DEBIT_WORDS)} THEN 'checking'
      WHEN {has('f', p.CREDIT_WORDS)} THEN 'credit_card' WHEN {has('f', p.SAVINGS_WORDS)} THEN 'savings' END AS account_type,
    coalesce({g1('text', r'\*(\d{4})' + fv.END)}, {g1('text', r'(?i)(?:bancolombia|nequi|daviplata)\s+(\d{4})' + fv.END)}) AS last_four,
    CASE WHEN skip_reason IS NOT NULL THEN 95 WHEN parsed_source <> 'manual' THEN 100
      WHEN regexp_matches(f, {q(p.ANY_MERCHANT)}) OR original_date IS NOT NULL OR contains(f, 'efectivo') THEN 90 ELSE 85 END AS confidence,
    CASE WHEN skip_reason IS NOT NULL THEN ''
      WHEN parsed_source <> 'manual' AND {first('text', p.MERCHANT)} IS NOT NULL THEN trim({first('text', p.MERCHANT)})
      WHEN {has('lower(text)', ['transferiste', 'enviaste', 'transferencia'])} THEN 'Transferencia' || coalesce(' a ' || phone, '')
      ELSE trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), {q(p.NOT_DESCRIPTION)}, ' ', 'g')), {q(p.LOOSE_ENDS)}, '', 'g'), '\\s+', ' ', 'g'))
      END AS description
  FROM timed),
parsed AS (SELECT *, {category('description')} AS category FROM described)"""

MESSAGES = f"{staged('message')}, {SHAPED}, {PARSED}"


# -- event time --------------------------------------------------------------------------
def fix_date(d: str) -> str:
    t = wide_trim(d)
    two, loose, iso = r"^(\d{2})/(\d{2})/(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"

    def n(pattern, group):
        return f"TRY_CAST(regexp_extract({t}, {q(pattern)}, {group}) AS INT)"

    def slashes(a, b, c):
        return f"lpad(CAST({a} AS VARCHAR), 2, '0') || '/' || lpad(CAST({b} AS VARCHAR), 2, '0') || '/' || CAST({c} AS VARCHAR)"

    return f"""CASE WHEN regexp_matches({t}, {q(two)}) THEN
        CASE WHEN {n(two, 2)} BETWEEN 1 AND 12 AND {n(two, 1)} BETWEEN 1 AND 31 AND {n(two, 3)} BETWEEN 2000 AND 2100 THEN {t} END
      WHEN regexp_matches({t}, {q(loose)}) THEN
        CASE WHEN {n(loose, 3)} NOT BETWEEN 2000 AND 2100 THEN NULL
          WHEN {n(loose, 2)} > 12 AND {n(loose, 1)} BETWEEN 1 AND 12 THEN {slashes(n(loose, 2), n(loose, 1), n(loose, 3))}
          ELSE {slashes(n(loose, 1), n(loose, 2), n(loose, 3))} END
      WHEN regexp_matches({t}, {q(iso)}) THEN
        CASE WHEN {n(iso, 2)} BETWEEN 1 AND 12 AND {n(iso, 3)} BETWEEN 1 AND 31 AND {n(iso, 1)} BETWEEN 2000 AND 2100
          THEN {slashes(n(iso, 3), n(iso, 2), n(iso, 1))} END END"""


def fix_time(t: str) -> str:
    c = wide_trim(t)
    return f"""CASE WHEN regexp_matches({c}, '^\\d{{1,2}}:\\d{{2}}$') AND CAST(split_part({c}, ':', 1) AS INT) <= 23
      AND CAST(split_part({c}, ':', 2) AS INT) <= 59 THEN lpad({c}, 5, '0') END"""


TIMED = f"""
fixed AS (SELECT *, {fix_date('original_date')} AS fd, {fix_time('original_time')} AS ft FROM parsed),
event AS (
  SELECT *, CASE WHEN fd IS NULL THEN today ELSE CAST(try_strptime(fd, '%d/%m/%Y') AS DATE) END AS date,
    CASE WHEN fd IS NOT NULL AND ft IS NOT NULL THEN ft ELSE strftime(received_at - INTERVAL 5 HOUR, '%H:%M') END AS time
  FROM fixed)"""


# -- rules -------------------------------------------------------------------------------
def _value(x) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, int) else q(x)


def _own(column: str) -> str:
    phone, other = "'31' || lpad(CAST(user_id AS VARCHAR), 8, '0')", "'31' || lpad(CAST(user_id + 25 AS VARCHAR), 8, '0')"
    return f"replace(replace(replace({column}, '@U', CAST(user_id AS VARCHAR)), '@P', {phone}), '@Q', {other})"


RULES = f"""
template({', '.join(RULE_COLUMNS)}) AS (VALUES
  {', '.join('(' + ', '.join(_value(x) for x in t) + ')' for t in RULE_TEMPLATES)}),
rule AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || suffix AS rule_id, user_id, name, priority, prompt_text,
    CASE WHEN active_mod = 0 THEN false ELSE user_id % greatest(active_mod, 1) = 0 END AS is_active,
    {_own('match_phone')} AS match_phone, {_own('transfer_to_account_id')} AS transfer_to_account_id,
    rule_type, condition_logic, {_own('conditions')} AS conditions, {_own('actions')} AS actions,
    CASE WHEN is_gone THEN DATE '2024-01-01' END AS deleted_at
  FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id FROM customer) CROSS JOIN template),
live_rule AS (SELECT * FROM rule WHERE is_active AND deleted_at IS NULL)"""


def _keywords(key: str, text: str) -> str:
    words = f"CAST(json_extract(conditions, '$.{key}') AS VARCHAR[])"
    hits = f"len(list_filter({words}, lambda k: contains(lower(coalesce({text}, '')), lower(k))))"
    return (
        f"(json_extract(conditions, '$.{key}') IS NULL OR CASE WHEN condition_logic = 'and' "
        f"THEN {hits} = len({words}) ELSE {hits} > 0 END)"
    )


def holds(description: str, raw_text: str, amount: str, source: str, account: str | None) -> str:
    """The condition test; ``account`` None leaves the feedback condition out."""
    low = "TRY_CAST(json_extract_string(conditions, '$.amount_between[0]') AS DECIMAL(30,10))"
    high = "TRY_CAST(json_extract_string(conditions, '$.amount_between[1]') AS DECIMAL(30,10))"
    parts = [
        _keywords("description_contains", description),
        f"(coalesce(json_extract_string(conditions, '$.description_regex'), '') = '' OR regexp_matches(coalesce({description}, ''), '(?i)' || json_extract_string(conditions, '$.description_regex')))",
        _keywords("raw_text_contains", raw_text),
        f"(json_extract(conditions, '$.amount_between') IS NULL OR coalesce({amount} >= {low}, true) AND coalesce({amount} <= {high}, true) AND {amount} IS NOT NULL)",
        f"(NOT list_contains(json_keys(conditions), 'amount_equals') OR coalesce({amount} = TRY_CAST(json_extract_string(conditions, '$.amount_equals') AS DECIMAL(30,10)), false))",
        f"(json_extract(conditions, '$.source') IS NULL OR coalesce(list_contains(CAST(json_extract(conditions, '$.source') AS VARCHAR[]), {source}), false))",
    ]
    if account is not None:
        parts.append(
            f"(coalesce(json_extract_string(conditions, '$.from_account'), '') = '' OR coalesce(json_extract_string(conditions, '$.from_account') = {account}, false))"
        )
    return " AND ".join(parts)


def act(name: str) -> str:
    return f"nullif(json_extract_string(actions, '$.{name}'), '')"


def applied(source: str) -> str:
    """``final`` rows of ``source`` after the ordered rules, by recursion over rule ranks."""
    link = f"coalesce({act('link_to_account')}, nullif(transfer_to_account_id, ''))"
    return f"""
ranked AS (
  SELECT *, {link} AS link, list_contains(json_keys(actions), 'set_category') AS sets_category,
    row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, rule_id) AS k
  FROM live_rule WHERE rule_type <> 'account_detection'),
candidate AS (
  SELECT t.id, k, rule_id, name, actions, link, sets_category,
    json_extract_string(conditions, '$.from_account') AS from_account,
    row_number() OVER (PARTITION BY t.id ORDER BY k) AS step
  FROM {source} AS t JOIN ranked AS r ON r.user_id = t.user_id
  WHERE {holds('t.description', 't.raw_text', 't.amount', 't.source', None)}),
fold AS (
  SELECT id, CAST(0 AS BIGINT) AS step, type, category_id, account_id, transfer_to_account_id, transfer_id, notes, '' AS fired
  FROM {source}
  UNION ALL
  SELECT f.id, f.step + 1,
    CASE WHEN ok THEN coalesce({act('set_type')}, f.type) ELSE f.type END,
    CASE WHEN ok AND sets_category THEN {act('set_category')} ELSE f.category_id END,
    CASE WHEN ok THEN coalesce({act('set_account')}, f.account_id) ELSE f.account_id END,
    CASE WHEN ok THEN coalesce(link, f.transfer_to_account_id) ELSE f.transfer_to_account_id END,
    CASE WHEN ok AND link IS NOT NULL THEN sha256(f.id || '|' || rule_id) ELSE f.transfer_id END,
    CASE WHEN ok AND {act('add_note')} IS NOT NULL
      THEN CASE WHEN coalesce(f.notes, '') = '' THEN {act('add_note')} ELSE f.notes || chr(10) || {act('add_note')} END ELSE f.notes END,
    CASE WHEN ok THEN f.fired || ',' || rule_id ELSE f.fired END
  FROM (SELECT fold.*, c.rule_id, c.actions, c.link, c.sets_category,
          coalesce(c.from_account, '') = '' OR coalesce(c.from_account = fold.account_id, false) AS ok
        FROM fold JOIN candidate AS c ON c.id = fold.id AND c.step = fold.step + 1) AS f),
final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)"""


# -- accounts ----------------------------------------------------------------------------
LIVE_ACCOUNT = "live_account AS (SELECT * FROM account WHERE is_active AND deleted_at IS NULL)"


def cascade(source: str, bank: str = "bank") -> str:
    """``cascaded``: the rows of ``source`` with cascade_account_id and cascade_tier."""
    def tier(where: str) -> str:
        return (
            "(SELECT account_id FROM live_account AS a WHERE a.user_id = s.user_id AND "
            f"a.institution = s.{bank}{where} ORDER BY a.name, a.account_id LIMIT 1)"
        )

    four, kind = " AND a.last_four = s.last_four", " AND a.type = s.account_type"
    return f"""
tiers AS (SELECT s.*, {tier(four + kind)} AS t1, {tier(four)} AS t2, {tier(kind)} AS t3, {tier('')} AS t4 FROM {source} AS s),
cascaded AS (
  SELECT *, coalesce(t1, t2, t3, t4) AS cascade_account_id,
    CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 WHEN t4 IS NOT NULL THEN 4 END AS cascade_tier
  FROM tiers)"""


DETECTED = f"""
detected AS (
  SELECT s.*, d.rule_id AS detection_rule_id, d.name AS detection_rule_name, {act('set_account').replace('actions', 'd.actions')} AS detected_account_id
  FROM parsed AS s LEFT JOIN (
    SELECT message_id, r.rule_id, r.name, r.actions FROM parsed AS m JOIN live_rule AS r
      ON r.user_id = m.user_id AND r.rule_type = 'account_detection'
    WHERE {holds('NULL', 'm.text', 'CAST(NULL AS DECIMAL(15,2))', 'CAST(NULL AS VARCHAR)', "CAST(NULL AS VARCHAR)")}
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY r.priority DESC, r.rule_id) = 1) AS d
  ON d.message_id = s.message_id)"""


# -- categories --------------------------------------------------------------------------
def tree() -> str:
    rows = []
    for parent, name, kind, nature, children in fv.CATEGORY_TREE:
        rows.append((parent, name, kind, nature, None))
        rows += [(s, n, kind, child_nature, parent) for s, n, child_nature in children]
    values = ", ".join("(" + ", ".join(_value(x) for x in r) + ")" for r in rows)
    return f"tree(slug, name, type, spending_nature, parent_slug) AS (VALUES {values})"


OWNED_CATEGORY = f"""
{tree()},
owned_category AS (
  SELECT sha256('category|' || CAST(user_id AS VARCHAR) || '|' || slug) AS category_id, user_id, name, slug, type, spending_nature,
    CASE WHEN parent_slug IS NOT NULL THEN sha256('category|' || CAST(user_id AS VARCHAR) || '|' || parent_slug) END AS parent_id
  FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id FROM customer) CROSS JOIN tree)"""

LIVE_CATEGORY = "live_category AS (SELECT * FROM category WHERE is_active AND deleted_at IS NULL)"

EFFECTS = """
effect AS (
  SELECT txn.*, account_id AS effect_account_id, CASE WHEN type = 'income' THEN amount ELSE -amount END AS delta
  FROM txn WHERE type IN ('income', 'expense') OR transfer_to_account_id IS NOT NULL
  UNION ALL SELECT txn.*, transfer_to_account_id, amount FROM txn WHERE type = 'transfer' AND transfer_to_account_id IS NOT NULL)"""
