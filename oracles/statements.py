"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracles.blocks import (
    DETECTED, EFFECTS, LIVE_ACCOUNT, LIVE_CATEGORY, MESSAGES, ORIGIN, OWNED_CATEGORY, PHONE,
    RULES, SHAPED, TIMED, act, applied, cascade, fix_date, fix_time, has, holds, q,
    staged, wide_trim,
)
from tallywell import fixed_values as fv

ORACLES: dict[str, str] = {}


def oracle(name: str, *blocks: str, select: str, recursive: bool = False) -> None:
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(blocks)} " if blocks else ""
    ORACLES[name] = head + select


ACCOUNT, CATEGORY, TXN, MESSAGE = (staged(v) for v in ("account", "category", "txn", "message"))
REQUEST, IMPORT = staged("parse_request"), staged("import_row")
SUBSCRIPTION, USAGE = staged("subscription"), staged("usage_stored")
SHAPE = f"{MESSAGE}, {SHAPED}"
READ = "readable AS (SELECT * FROM shaped WHERE problem IS NULL)"
TS = "TIMESTAMP '2024-02-01 00:00:00'"

# -- scope, owners -----------------------------------------------------------------------
oracle("live_accounts", ACCOUNT, LIVE_ACCOUNT, select="SELECT account_id, user_id, name, type, balance FROM live_account")
oracle("owner_scope", ACCOUNT, LIVE_ACCOUNT, TXN, select="""
SELECT id, t.user_id, t.account_id, name AS account_name FROM txn t JOIN live_account a
ON a.user_id = t.user_id AND a.account_id = t.account_id WHERE t.deleted_at IS NULL""")
KEYS = """keys AS (SELECT CAST(c_nationkey AS BIGINT) AS user_id, sha256('key-' || CAST(c_custkey AS VARCHAR)) AS key_hash
  FROM customer WHERE c_custkey % 11 <> 0),
asked AS (SELECT o_orderkey AS request_id, sha256('key-' || CAST(o_custkey + o_orderkey % 2 * 20 AS VARCHAR)) AS key_hash, o_orderdate FROM orders)"""
oracle("owner_by_key", KEYS, select="SELECT request_id, user_id, a.key_hash FROM asked a LEFT JOIN keys k ON k.key_hash = a.key_hash")
oracle("last_key_use", KEYS, select="SELECT a.key_hash, max(o_orderdate) AS last_used_at FROM asked a JOIN keys k ON k.key_hash = a.key_hash GROUP BY ALL")

# -- parsing -----------------------------------------------------------------------------
oracle("channel_union", SHAPE, select="SELECT message_id, channel, text, source, problem FROM shaped")
oracle("email_extract", SHAPE, select="SELECT message_id, text, source, problem FROM shaped WHERE channel = 'email'")
oracle("bulk_explode", SHAPE, READ, select="""
SELECT message_id, CAST(position AS BIGINT) AS position, text, 'sms-bulk' AS source FROM (
  SELECT message_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS text FROM (
    SELECT message_id, CASE message_id % 4 WHEN 0 THEN [text, ' ok '] WHEN 1 THEN [text, channel] WHEN 2 THEN [channel, text]
      ELSE list_filter(string_split(text || chr(13) || chr(10) || chr(9) || chr(13) || chr(10) || 'fin', chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') END AS l
    FROM readable))""")
oracle("parse_amount_source", MESSAGES, select="SELECT message_id, amount, parsed_source, description FROM parsed")
oracle("parse_bank_fields", MESSAGES, select="SELECT message_id, bank, payment_type, account_type, last_four, confidence FROM parsed")
oracle("parse_category", MESSAGES, select="SELECT message_id, description, category FROM parsed")
oracle("parse_dates", MESSAGES, select="SELECT message_id, original_date, original_time FROM parsed")
oracle("classify_skips", MESSAGES, select="SELECT channel, skip_reason AS reason, count(*) AS messages FROM parsed WHERE NOT is_transaction GROUP BY ALL")
oracle("validate_parsed", TXN, select="""
SELECT id, CASE WHEN ok THEN a END AS amount, CASE WHEN ok THEN d END AS description, NOT ok AS bad_json,
  coalesce(CASE WHEN ok THEN t END, true) AS is_transaction,
  CASE WHEN NOT coalesce(CASE WHEN ok THEN t END, true) THEN NULL
    WHEN coalesce(CASE WHEN ok THEN a END, 0) <= 0 THEN 'Invalid amount'
    WHEN trim(d) = '' THEN 'Missing description' WHEN c = '' THEN 'Missing category' END AS reject_reason
FROM (SELECT id, seq % 13 = 0 OR seq % 17 <> 0 AS ok, CASE WHEN seq % 5 <> 0 THEN amount END AS a,
  CASE WHEN seq % 7 = 0 THEN '  ' ELSE description END AS d, CASE WHEN seq % 11 = 0 THEN '' ELSE source END AS c,
  CASE WHEN seq % 3 = 0 THEN seq % 2 = 0 END AS t FROM txn)""")
oracle("validate_values", TXN, select="""
SELECT id, coalesce(regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}$') AND TRY_CAST(day[6:7] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(day[9:10] AS INT) BETWEEN 1 AND 31, false) AS date_ok,
  regexp_matches(clock, '^([01]\\d|2[0-3]):([0-5]\\d)$') AS time_ok, a > 0 AS amount_ok,
  regexp_matches(mail, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS mail_ok
FROM (SELECT id, CASE seq % 4 WHEN 0 THEN strftime(date, '%d/%m/%Y') WHEN 1 THEN replace(strftime(date, '%Y-%m-%d'), '-0', '-4') ELSE strftime(date, '%Y-%m-%d') END AS day,
  CASE WHEN seq % 5 = 0 THEN replace(time, '0', '7') ELSE time END AS clock,
  CASE seq % 6 WHEN 0 THEN -amount WHEN 1 THEN 0 ELSE amount END AS a,
  replace(description, ' ', CASE WHEN seq % 3 = 0 THEN ' ' ELSE '.' END) || CASE WHEN seq % 7 = 0 THEN '' ELSE '@mail.co' END AS mail FROM txn)""")
oracle("event_time_fix", TXN, f"""
parts AS (SELECT id, seq, time AS t, CAST(day(date) AS VARCHAR) AS d, CAST(month(date) AS VARCHAR) AS m,
  CASE WHEN seq % 9 = 0 THEN '1999' ELSE '20' || substring(CAST(year(date) AS VARCHAR), 3, 2) END AS y FROM txn),
stated AS (SELECT id, CASE seq % 8 WHEN 0 THEN lpad(d, 2, '0') || '/' || lpad(m, 2, '0') || '/' || y WHEN 1 THEN lpad(m, 2, '0') || '/' || lpad(d, 2, '0') || '/' || y
    WHEN 2 THEN d || '/' || m || '/' || y WHEN 3 THEN m || '/' || d || '/' || y WHEN 4 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0')
    WHEN 5 THEN ' 1/45/' || y || ' ' WHEN 6 THEN d || '/' || m || '/' || substring(y, 3, 2) END AS sd,
  CASE seq % 6 WHEN 0 THEN regexp_replace(t, '^0', '') WHEN 1 THEN ' ' || t WHEN 2 THEN replace(t, '1', '7') WHEN 3 THEN t || ':00' WHEN 4 THEN t END AS sc FROM parts),
fixed AS (SELECT id, {fix_date('sd')} AS fd, {fix_time('sc')} AS ft FROM stated)""", select="""
SELECT id, fd AS fixed_date, substring(fd, 7, 4) || '-' || substring(fd, 4, 2) || '-' || substring(fd, 1, 2) AS iso_date, ft AS fixed_time FROM fixed""")
oracle("event_time_choose", MESSAGES, TIMED, select="SELECT message_id, date, time FROM event")
oracle("parse_preview", MESSAGES, ACCOUNT, LIVE_ACCOUNT, OWNED_CATEGORY,
       "wanted AS (SELECT * FROM parsed WHERE is_transaction)", cascade("wanted"), select=f"""
SELECT message_id, amount, coalesce({fix_date('original_date')}, original_date) AS original_date, coalesce({fix_time('original_time')}, original_time) AS original_time,
  coalesce(cascade_account_id, (SELECT min_by(account_id, (name, account_id)) FROM live_account a WHERE a.user_id = c.user_id AND institution = 'cash'),
    (SELECT min_by(account_id, (name, account_id)) FROM live_account a WHERE a.user_id = c.user_id AND institution = 'bancolombia')) AS account_id, o.category_id
FROM cascaded c LEFT JOIN owned_category o ON o.user_id = c.user_id AND o.slug = c.category""")

# -- transfers ---------------------------------------------------------------------------
oracle("transfer_extract", SHAPE, READ, select=f"""
SELECT message_id, {PHONE} AS phone, {ORIGIN} AS origin_account, {has('lower(text)', fv.TRANSFER_KEYWORDS)} AS is_transfer FROM readable""")
def legs(source: str, account: str, category: str, notes: str, more: str = "") -> str:
    """``legs``: the rows of ``source`` as ledger legs; ``more`` names columns to carry along."""
    return f"""
phone_rule AS (SELECT * FROM live_rule WHERE match_phone IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, match_phone ORDER BY priority DESC, rule_id) = 1),
base AS (SELECT p.*, {notes} AS notes, r.rule_id, r.name AS rule_name, r.transfer_to_account_id AS target,
    m.category_id AS missing, coalesce(t.category_id, m.category_id) AS pair_category
  FROM {source} p LEFT JOIN phone_rule r ON r.user_id = p.user_id AND r.match_phone = p.phone
  LEFT JOIN owned_category m ON m.user_id = p.user_id AND m.slug = 'missing'
  LEFT JOIN owned_category t ON t.user_id = p.user_id AND t.slug = 'transfer' WHERE p.is_transaction),
legs AS (
  SELECT message_id, CAST(0 AS BIGINT) AS leg, 'expense' AS type, {category} AS category_id, {account} AS account_id, NULL AS transfer_to_account_id, NULL AS transfer_id,
    description, notes, amount{more} FROM base WHERE NOT (is_transfer OR category = 'transfer')
  UNION ALL SELECT message_id, 0, 'expense', missing, {account}, NULL, NULL, description, concat_ws(chr(10), notes, 'Transfer - no matching phone found'), amount{more}
    FROM base WHERE (is_transfer OR category = 'transfer') AND phone IS NULL
  UNION ALL SELECT message_id, 0, 'expense', missing, {account}, NULL, NULL, description, concat_ws(chr(10), notes, 'Transfer to ' || phone || ' - no matching rule'), amount{more}
    FROM base WHERE (is_transfer OR category = 'transfer') AND phone IS NOT NULL AND rule_id IS NULL
  UNION ALL SELECT message_id, 0, 'transfer', pair_category, {account}, target, sha256('transfer|' || CAST(message_id AS VARCHAR)), 'Transfer to ' || rule_name,
    concat_ws(chr(10), notes, 'Internal transfer to ' || phone), amount{more} FROM base WHERE (is_transfer OR category = 'transfer') AND rule_id IS NOT NULL
  UNION ALL SELECT message_id, 1, 'transfer', pair_category, target, NULL, sha256('transfer|' || CAST(message_id AS VARCHAR)),
    'Transfer from ' || CASE WHEN description = '' THEN 'Bancolombia' ELSE description END,
    'Internal transfer from account ending in ' || coalesce(origin_account, 'unknown'), amount{more} FROM base WHERE (is_transfer OR category = 'transfer') AND rule_id IS NOT NULL)"""


LEGS = legs("parsed", "bank", "category", "CASE WHEN p.message_id % 3 = 0 THEN 'nota' END")
ID = "CAST(message_id AS VARCHAR) || '-' || CAST(leg AS VARCHAR)"
oracle("transfer_split", MESSAGES, RULES, OWNED_CATEGORY, LEGS, select=f"SELECT {ID} AS id, * FROM legs")
oracle("transfer_pairs", MESSAGES, RULES, OWNED_CATEGORY, LEGS, select=f"""
SELECT transfer_id, count(*) AS legs, max({ID}) FILTER (transfer_to_account_id IS NOT NULL) AS outgoing_id, max({ID}) FILTER (transfer_to_account_id IS NULL) AS incoming_id,
  max(account_id) FILTER (transfer_to_account_id IS NOT NULL) AS from_account_id, max(transfer_to_account_id) AS to_account_id, max(amount) AS amount
FROM legs WHERE transfer_id IS NOT NULL GROUP BY transfer_id""")

# -- accounts ----------------------------------------------------------------------------
oracle("account_cascade", MESSAGES, ACCOUNT, LIVE_ACCOUNT, cascade("parsed"), select="SELECT message_id, user_id, cascade_account_id, CAST(cascade_tier AS BIGINT) AS cascade_tier FROM cascaded")
FALLBACK = """
defaults AS (SELECT user_id, min_by(account_id, (name, account_id)) FILTER (institution = 'cash') AS cash,
  min_by(account_id, (name, account_id)) FILTER (institution = 'bancolombia') AS bank_default FROM live_account GROUP BY user_id),
placed AS (SELECT c.*, CASE channel WHEN 'email' THEN cascade_account_id WHEN 'chat' THEN coalesce(detected_account_id, cascade_account_id, cash)
  ELSE coalesce(detected_account_id, cascade_account_id, cash, bank_default) END AS account_id FROM cascaded c LEFT JOIN defaults d ON d.user_id = c.user_id)"""
oracle("account_fallback", MESSAGES, RULES, DETECTED, ACCOUNT, LIVE_ACCOUNT, cascade("detected"), FALLBACK, select="SELECT message_id, channel, account_id FROM placed")
oracle("account_detect", MESSAGES, RULES, DETECTED, select="SELECT message_id, detection_rule_id, detected_account_id FROM detected")
SUITABLE = "suitable AS (SELECT * FROM account WHERE type <> 'cash' AND is_active AND (institution <> '' OR coalesce(last_four, '') <> ''))"
oracle("accounts_without_rule", ACCOUNT, SUITABLE, RULES, select=f"""
SELECT account_id, user_id, name FROM suitable s WHERE NOT EXISTS (SELECT 1 FROM live_rule r WHERE r.rule_type = 'account_detection'
  AND r.user_id = s.user_id AND {act('set_account')} = s.account_id)""")
oracle("account_rules_gen", ACCOUNT, SUITABLE, select="""
SELECT sha256('account-rule|' || account_id) AS rule_id, user_id, 'Account: ' || name AS name, 100 AS priority,
  '{"raw_text_contains":["' || institution || '"' || coalesce(',"' || last_four || '"', '') || ']}' AS conditions, '{"set_account":"' || account_id || '"}' AS actions FROM suitable""")
oracle("balance_lookup", ACCOUNT, TXN, """asked AS (SELECT id, CASE WHEN seq % 5 = 0 THEN account_id || '0' ELSE account_id END AS account_id, user_id FROM txn)""", select="""
SELECT id, k.account_id, CASE WHEN a.account_id IS NOT NULL THEN coalesce(balance, 0) END AS balance FROM asked k
LEFT JOIN account a ON a.account_id = k.account_id AND a.user_id = k.user_id AND a.deleted_at IS NULL""")

# -- categories --------------------------------------------------------------------------
RENAMED = "CASE category " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.RENAMED_SLUGS.items()) + " ELSE category END"
oracle("category_lookup", MESSAGES, OWNED_CATEGORY, select=f"""
SELECT message_id, category, a.category_id, {RENAMED} AS renamed, b.category_id AS renamed_id FROM parsed p
LEFT JOIN owned_category a ON a.user_id = p.user_id AND a.slug = p.category
LEFT JOIN owned_category b ON b.user_id = p.user_id AND b.slug = {RENAMED}""")
oracle("category_tree", CATEGORY, select="""
SELECT c.category_id, c.slug, p.slug AS parent_slug, p.name AS parent_name FROM category c LEFT JOIN category p ON p.category_id = c.parent_id""")
oracle("categories_listed", CATEGORY, select="SELECT category_id, user_id, name, is_active FROM category WHERE deleted_at IS NULL")
OFFERED = """
offer AS (SELECT CAST(c_nationkey % 7 AS BIGINT) AS user_id, 'nation-' || CAST(c_custkey % 40 AS VARCHAR) AS slug, 'New nation-' || CAST(c_custkey % 40 AS VARCHAR) AS name,
  'expense' AS type, 'must' AS spending_nature, min(CASE c_custkey % 3 WHEN 1 THEN 'nation-3' WHEN 2 THEN 'nowhere' END) AS parent_slug
  FROM customer GROUP BY ALL),
new_id AS (SELECT *, sha256('category|' || CAST(user_id AS VARCHAR) || '|' || slug) AS made_id FROM offer),
parents AS (SELECT user_id, slug, min(category_id) AS category_id FROM category GROUP BY ALL
  UNION ALL SELECT user_id, slug, made_id FROM new_id n WHERE parent_slug IS NULL AND NOT EXISTS (SELECT 1 FROM category c WHERE c.user_id = n.user_id AND c.slug = n.slug)),
placed_offer AS (SELECT n.*, p.category_id AS found_parent FROM new_id n LEFT JOIN parents p ON p.user_id = n.user_id AND p.slug = n.parent_slug)"""
oracle("category_upsert", CATEGORY, OFFERED, select="""
SELECT category_id, c.user_id, c.slug, c.name, CASE WHEN o.slug IS NULL THEN c.type ELSE o.type END AS type,
  CASE WHEN o.slug IS NULL THEN c.spending_nature ELSE o.spending_nature END AS spending_nature,
  CASE WHEN o.parent_slug IS NOT NULL THEN o.found_parent ELSE c.parent_id END AS parent_id,
  CASE WHEN o.slug IS NULL THEN c.is_default ELSE true END AS is_default, CASE WHEN o.slug IS NULL THEN 'kept' ELSE 'updated' END AS outcome,
  CASE WHEN o.slug IS NOT NULL THEN o.name WHEN c.is_default THEN c.name END AS en_name, 'Es ' || o.slug AS es_name
FROM category c LEFT JOIN placed_offer o ON o.user_id = c.user_id AND o.slug = c.slug AND (o.parent_slug IS NULL OR o.found_parent IS NOT NULL)
UNION ALL SELECT made_id, user_id, slug, name, type, spending_nature, found_parent, true, 'inserted', name, 'Es ' || slug FROM placed_offer n
WHERE (parent_slug IS NULL OR found_parent IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM category c WHERE c.user_id = n.user_id AND c.slug = n.slug)""")
oracle("category_upsert_orphans", CATEGORY, OFFERED, select="SELECT user_id, slug, parent_slug FROM placed_offer WHERE parent_slug IS NOT NULL AND found_parent IS NULL")
oracle("insert_ignored", CATEGORY, OFFERED, select="""
SELECT user_id, slug, name FROM category UNION ALL
SELECT user_id, slug, name FROM offer o WHERE NOT EXISTS (SELECT 1 FROM category c WHERE c.user_id = o.user_id AND c.slug = o.slug)""")
oracle("default_provisioning", OWNED_CATEGORY, select="SELECT category_id, user_id, slug, name, type, spending_nature, parent_id, true AS is_default, name AS en_name FROM owned_category")
oracle("default_accounts", select="""
SELECT DISTINCT sha256('account|' || CAST(user_id AS VARCHAR) || '|cash') AS account_id, user_id, 'Cash' AS name, 'cash' AS type,
  CAST(0 AS DECIMAL(15,2)) AS balance, true AS is_default, 'free' AS plan, 'active' AS status FROM events""")
oracle("default_phone_rules", ACCOUNT, OWNED_CATEGORY, select="""
SELECT sha256('wallet-rule|' || account_id) AS rule_id, a.user_id, 200 AS priority, '3104633357' AS match_phone, account_id AS transfer_to_account_id,
  '{"contains_text":["Transferiste","*3104633357"]}' AS conditions, '{"set_category":"' || category_id || '","link_account":"' || account_id || '"}' AS actions
FROM account a JOIN owned_category c ON c.user_id = a.user_id AND c.slug = 'transfer' WHERE institution = 'nequi'""")
oracle("slug_backfill", ACCOUNT, select="""
SELECT account_id, name || ' Y Otra' AS name, CASE WHEN is_default THEN 'kept' ELSE lower(replace(name || ' Y Otra', ' ', '-')) END AS slug FROM account""")
oracle("localised_names", CATEGORY, TXN, select="""
SELECT id, CASE WHEN c.is_default THEN 'El ' || c.name ELSE c.name END AS es_name, c.name AS pt_name FROM txn t LEFT JOIN category c ON c.category_id = t.category_id""")

# -- rules -------------------------------------------------------------------------------
oracle("rule_match", TXN, RULES, select=f"""
SELECT t.id, r.rule_id FROM txn t JOIN live_rule r ON r.user_id = t.user_id AND r.rule_type <> 'account_detection'
WHERE {holds('t.description', 't.raw_text', 't.amount', 't.source', 't.account_id')}""")
oracle("rules_refused", TXN, """
mistake(suffix, refusal) AS (VALUES ('91', 'wrong type: description_contains'), ('92', 'unreadable conditions'), ('93', 'bad pattern'),
  ('94', 'wrong type: amount_between'), ('95', 'wrong type: source')),
owner AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id FROM customer)""", select="""
SELECT CAST(user_id AS VARCHAR) || '-' || suffix AS rule_id, refusal, (SELECT count(*) FROM txn t WHERE t.user_id = owner.user_id) AS rows_spared FROM owner, mistake""")
APPLIED = applied("txn")
oracle("rule_apply", TXN, RULES, APPLIED, recursive=True, select="""
SELECT id, type, category_id, account_id, transfer_to_account_id, transfer_id, notes, ltrim(fired, ',') AS fired FROM final""")
oracle("rule_apply_messages", MESSAGES, RULES, """
incoming AS (SELECT CAST(message_id AS VARCHAR) AS id, user_id, 'expense' AS type, category AS category_id, bank AS account_id,
  CAST(NULL AS VARCHAR) AS transfer_to_account_id, CAST(NULL AS VARCHAR) AS transfer_id, CAST(NULL AS VARCHAR) AS notes,
  description, text AS raw_text, amount, source FROM parsed WHERE is_transaction)""", applied("incoming"), recursive=True,
       select="SELECT id, type, category_id, account_id, notes, ltrim(fired, ',') AS fired FROM final")
oracle("override_flags", TXN, ACCOUNT, CATEGORY, RULES, APPLIED, recursive=True, select="""
SELECT f.id, f.type IS DISTINCT FROM t.type AS type_changed, f.category_id IS DISTINCT FROM t.category_id AS category_id_changed,
  f.account_id IS DISTINCT FROM t.account_id AS account_id_changed, a.name AS account_name, c.name AS category_name
FROM final f JOIN txn t ON t.id = f.id LEFT JOIN account a ON a.account_id = f.account_id LEFT JOIN category c ON c.category_id = f.category_id""")
oracle("applied_rule_audit", TXN, RULES, APPLIED, """
hits AS (SELECT unnest(string_split(ltrim(fired, ','), ',')) AS rule_id FROM final WHERE fired <> '')""", recursive=True, select="""
SELECT h.rule_id, r.name AS rule_name, count(*) AS times FROM hits h JOIN rule r ON r.rule_id = h.rule_id GROUP BY ALL""")
TRANSFER_DIGEST = """
transfer_text AS (SELECT user_id, 'TRANSFERS: Messages with "Transferiste"/"Enviaste" are transfers. Known phones: '
  || string_agg('*' || match_phone || '→transfer', ', ' ORDER BY priority DESC, rule_id) || '. Unknown phones→category:"missing".' AS transfer_digest
  FROM live_rule WHERE coalesce(match_phone, '') <> '' GROUP BY user_id)"""


def _listed(key: str, label: str) -> str:
    words = f"CAST(json_extract(conditions, '$.{key}') AS VARCHAR[])"
    return f"CASE WHEN len({words}) > 0 THEN '{label} [' || array_to_string({words}, ', ') || ']' END"


RULE_DIGEST = f"""
digest_line AS (SELECT user_id, priority, rule_id, name, condition_logic,
    concat_ws(CASE WHEN condition_logic = 'and' THEN ' AND ' ELSE ' OR ' END, {_listed('description_contains', 'description contains')},
      'description matches /' || nullif(json_extract_string(conditions, '$.description_regex'), '') || '/',
      'amount between ' || json_extract_string(conditions, '$.amount_between[0]') || '-' || json_extract_string(conditions, '$.amount_between[1]'),
      {_listed('source', 'source is')}) AS cond_text,
    concat_ws(', ', 'type→"' || {act('set_type')} || '"', 'category→"' || {act('set_category')} || '"') AS act_text
  FROM live_rule WHERE rule_type <> 'account_detection' AND coalesce(match_phone, '') = ''
    AND ({act('set_type')} IS NOT NULL OR {act('set_category')} IS NOT NULL OR {act('link_to_account')} IS NOT NULL)),
rule_text AS (SELECT user_id, coalesce('AUTOMATION RULES (apply these when conditions match, they override default categorization):' || chr(10)
  || string_agg('- RULE "' || name || '" (' || upper(condition_logic) || '): IF ' || cond_text || ' THEN ' || act_text, chr(10) ORDER BY priority DESC, rule_id)
    FILTER (cond_text <> '' AND act_text <> '')
  || chr(10) || 'If a rule matches, use the specified values. These rules are deterministic overrides from the user.', '') AS rule_digest
  FROM digest_line GROUP BY user_id)"""
oracle("rule_digest", RULES, RULE_DIGEST, select="SELECT user_id, rule_digest FROM rule_text")
oracle("transfer_digest", RULES, TRANSFER_DIGEST, select="SELECT user_id, transfer_digest FROM transfer_text")
oracle("parse_context", MESSAGES, RULES, DETECTED, RULE_DIGEST, TRANSFER_DIGEST, """
prompts AS (SELECT user_id, string_agg(prompt_text, chr(10) || chr(10) ORDER BY priority DESC, rule_id) AS p FROM live_rule WHERE length(prompt_text) > 0 GROUP BY user_id),
context AS (SELECT message_id, concat_ws(chr(10) || chr(10), 'ACCOUNT CONTEXT: This message is from account "' || detection_rule_name || '" (id: ' || detected_account_id || ').',
  p, transfer_digest, nullif(rule_digest, '')) AS c FROM detected d LEFT JOIN prompts USING (user_id) LEFT JOIN transfer_text USING (user_id) LEFT JOIN rule_text USING (user_id))""",
       select="SELECT message_id, sha256(c) AS context_hash, CAST(length(c) AS BIGINT) AS context_length FROM context")
oracle("rule_defaults", select="""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Unnamed Rule' END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 ELSE true END AS is_active,
  CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 ELSE 50 END AS INT) AS priority, CASE WHEN p_partkey % 7 = 1 THEN 'transfer' ELSE 'general' END AS rule_type,
  CASE WHEN p_partkey % 2 = 1 THEN 'and' ELSE 'or' END AS condition_logic,
  CASE WHEN p_partkey % 4 = 0 THEN '{"amount_equals":' || CAST(p_size AS VARCHAR) || '}' ELSE '{}' END AS conditions,
  CASE WHEN p_partkey % 6 = 0 THEN '{"set_category":"' || p_brand || '"}' ELSE '{}' END AS actions FROM part
UNION ALL SELECT p_partkey, 'Unnamed Rule', true, 50, 'general', 'or', '{}', '{}' FROM part""")
oracle("rules_listed", RULES, select="""
SELECT rule_id, rule_type, CAST(priority AS BIGINT) AS priority, is_active FROM rule WHERE deleted_at IS NULL AND (is_active OR rule_type = 'account_detection')""")

# -- duplicates and the parse cache ------------------------------------------------------
DUP = """
dup AS (SELECT *, CAST(message_id AS VARCHAR) AS id, coalesce(source, parsed_source) AS src, CASE WHEN message_id % 31 = 0 THEN received_at END AS deleted_at
  FROM event WHERE is_transaction AND date IS NOT NULL),
exact AS (SELECT n.id, min_by(s.id, (s.received_at, s.message_id)) AS exact_of FROM dup n JOIN dup s ON s.user_id = n.user_id AND s.src = n.src AND s.text = n.text
  AND s.deleted_at IS NULL AND (s.received_at, s.message_id) < (n.received_at, n.message_id) GROUP BY n.id),
near AS (SELECT n.id, min_by(s.id, (s.received_at, s.message_id)) AS near_of FROM dup n JOIN dup s ON s.user_id = n.user_id AND s.date = n.date AND s.amount = n.amount
  AND s.bank = n.bank AND s.deleted_at IS NULL AND (s.received_at, s.message_id) < (n.received_at, n.message_id) GROUP BY n.id)"""
oracle("dup_exact", MESSAGES, TIMED, DUP, select="SELECT id, exact_of FROM dup LEFT JOIN exact USING (id)")
oracle("dup_near", MESSAGES, TIMED, DUP, select="SELECT id, near_of FROM dup LEFT JOIN near USING (id)")
oracle("dup_flags", MESSAGES, TIMED, DUP, select="""
SELECT id, 'pending_review' AS duplicate_status, coalesce(exact_of, near_of) AS duplicate_of FROM dup LEFT JOIN exact USING (id) LEFT JOIN near USING (id)
WHERE coalesce(exact_of, near_of) IS NOT NULL""")
oracle("dup_side_by_side", TXN, select="""
SELECT f.id, f.duplicate_status, f.duplicate_of, f.date, f.amount, f.account_id, f.description, o.date AS original_date, o.amount AS original_amount,
  o.account_id AS original_account_id, o.description AS original_description FROM txn f LEFT JOIN txn o ON o.id = f.duplicate_of WHERE f.duplicate_status IS NOT NULL""")
oracle("ttl_cache_hits", MESSAGES, RULES, DETECTED, RULE_DIGEST, TRANSFER_DIGEST, f"""
prompt_list AS (SELECT user_id, list(prompt_text ORDER BY priority DESC, rule_id) AS p FROM live_rule WHERE length(prompt_text) > 0 GROUP BY user_id),
section AS (SELECT message_id, list_filter(list_concat(['ACCOUNT CONTEXT: This message is from account "' || detection_rule_name || '" (id: ' || detected_account_id || ').'],
  coalesce(p, CAST([] AS VARCHAR[])), [transfer_digest, rule_digest]), lambda s: coalesce(s, '') <> '') AS l
  FROM detected d LEFT JOIN prompt_list USING (user_id) LEFT JOIN transfer_text USING (user_id) LEFT JOIN rule_text USING (user_id)),
sent AS (SELECT p.*, text || CASE WHEN len(l) > 0 THEN CAST(to_json(l) AS VARCHAR) ELSE '' END AS sent FROM parsed p JOIN section USING (message_id)),
arrival AS (SELECT message_id, is_transaction AND amount > 0 AND trim(description) <> '' AS is_transaction,
  {q(fv.CACHE_KEY_PREFIX)} || sha256(lower({wide_trim('sent')})) AS cache_key, CAST(floor(epoch_us(received_at) / 1000000.0) AS BIGINT) AS second FROM sent),
moment AS (SELECT cache_key, second, min(message_id) AS first_id FROM arrival WHERE is_transaction GROUP BY ALL),
anchor AS (SELECT cache_key, min(second) AS second FROM moment GROUP BY cache_key
  UNION ALL SELECT a.cache_key, (SELECT min(m.second) FROM moment m WHERE m.cache_key = a.cache_key AND m.second >= a.second + 86400) FROM anchor a WHERE a.second IS NOT NULL),
miss AS (SELECT first_id FROM anchor JOIN moment USING (cache_key, second))""", recursive=True, select="""
SELECT message_id, cache_key, coalesce(is_transaction, false) AND message_id NOT IN (SELECT first_id FROM miss) AS cache_hit FROM arrival""")

# -- balances ----------------------------------------------------------------------------
oracle("balance_effects", TXN, EFFECTS, select="SELECT id, effect_account_id, delta FROM effect")
oracle("balances_applied", ACCOUNT, TXN, EFFECTS, select="""
SELECT a.account_id, a.balance, CAST(coalesce(a.balance, 0) + coalesce(d, 0) AS DECIMAL(38,2)) AS new_balance FROM account a
LEFT JOIN (SELECT effect_account_id, sum(delta) AS d FROM effect GROUP BY ALL) e ON e.effect_account_id = a.account_id""")
oracle("account_sums", TXN, select="SELECT account_id, type, CAST(sum(amount) AS DECIMAL(38,2)) AS total, count(*) AS transactions FROM txn GROUP BY ALL")
oracle("running_balance", ACCOUNT, TXN, EFFECTS, select="""
SELECT id, effect_account_id, delta, CAST(coalesce(a.balance, 0) + sum(delta) OVER (PARTITION BY effect_account_id ORDER BY created_at, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS balance_after FROM effect LEFT JOIN account a ON a.account_id = effect_account_id""")
oracle("month_closing", ACCOUNT, TXN, EFFECTS, """
monthly AS (SELECT effect_account_id AS account_id, strftime(date, '%Y-%m') AS month, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS money_in,
  sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS money_out, sum(delta) AS net FROM effect GROUP BY ALL)""", select="""
SELECT m.account_id, month, CAST(money_in AS DECIMAL(38,2)) AS money_in, CAST(money_out AS DECIMAL(38,2)) AS money_out, CAST(net AS DECIMAL(38,2)) AS net,
  CAST(coalesce(a.balance, 0) + sum(net) OVER (PARTITION BY m.account_id ORDER BY month) AS DECIMAL(38,2)) AS closing_balance
FROM monthly m LEFT JOIN account a ON a.account_id = m.account_id""")

# -- usage -------------------------------------------------------------------------------
MONTHLY = """
monthly AS (SELECT user_id, strftime(received_at, '%Y-%m') AS month, CAST(sum(p) AS BIGINT) AS ai_parses_used, CAST(sum(t) AS BIGINT) AS transactions_count FROM (
  SELECT user_id, received_at, 1 AS p, 0 AS t FROM parse_request UNION ALL SELECT user_id, created_at, 0, 1 FROM txn) GROUP BY ALL)"""
oracle("usage_monthly", REQUEST, TXN, MONTHLY, select="SELECT * FROM monthly")
oracle("usage_merged", REQUEST, TXN, MONTHLY, USAGE, select="""
SELECT user_id, month, CAST(coalesce(s.ai_parses_used, 0) + coalesce(m.ai_parses_used, 0) AS BIGINT) AS ai_parses_used, coalesce(s.ai_parses_limit, 15) AS ai_parses_limit,
  CAST(coalesce(s.transactions_count, 0) + coalesce(m.transactions_count, 0) AS BIGINT) AS transactions_count, coalesce(s.transactions_limit, 50) AS transactions_limit
FROM usage_stored s FULL JOIN monthly m USING (user_id, month)""")
oracle("quota_admission", REQUEST, USAGE, SUBSCRIPTION, """
numbered AS (SELECT r.*, strftime(received_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(received_at, '%Y-%m') ORDER BY received_at, request_id) AS n FROM parse_request r),
known AS (SELECT n.*, coalesce(u.ai_parses_used, 0) AS prior, EXISTS (SELECT 1 FROM subscription s WHERE s.user_id = n.user_id AND plan = 'pro' AND status = 'active') AS pro
  FROM numbered n LEFT JOIN usage_stored u ON u.user_id = n.user_id AND u.month = n.month)""", select="""
SELECT request_id, user_id, month, pro OR prior + n <= 15 AS allowed, CAST(CASE WHEN pro THEN prior + n ELSE least(prior + n, greatest(15, prior)) END AS BIGINT) AS used,
  CAST(CASE WHEN pro THEN -1 ELSE 15 END AS BIGINT) AS "limit" FROM known""")
oracle("usage_retention", USAGE, select="SELECT user_id, month FROM usage_stored WHERE month >= '2023-02'")
PRO = "pro AS (SELECT user_id FROM subscription WHERE plan = 'pro' AND status = 'active')"
oracle("usage_vs_limits", ACCOUNT, LIVE_ACCOUNT, CATEGORY, LIVE_CATEGORY, RULES, TXN, REQUEST, SUBSCRIPTION, PRO, select="""
SELECT user_id, resource, used, CAST(CASE WHEN free THEN "limit" ELSE -1 END AS BIGINT) AS "limit", free AND used > "limit" AS over_limit
FROM (SELECT *, user_id NOT IN (SELECT user_id FROM pro) AS free FROM (
  SELECT user_id, 'accounts' AS resource, count(*) AS used, 4 AS "limit" FROM live_account GROUP BY ALL UNION ALL
  SELECT user_id, 'categories', count(*), 15 FROM live_category GROUP BY ALL UNION ALL SELECT user_id, 'automations', count(*), 5 FROM live_rule GROUP BY ALL UNION ALL
  SELECT user_id, 'transactions', count(*), 50 FROM txn WHERE strftime(created_at, '%Y-%m') = '1998-07' GROUP BY ALL UNION ALL
  SELECT user_id, 'ai_parses', count(*), 15 FROM parse_request WHERE strftime(received_at, '%Y-%m') = '2024-01' GROUP BY ALL))""")
oracle("limit_enforcement", CATEGORY, LIVE_CATEGORY, IMPORT, SUBSCRIPTION, PRO, """
counted AS (SELECT user_id, import_id, count(DISTINCT coalesce("Category", '')) AS n FROM import_row GROUP BY ALL),
wanted AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY import_id) AS k FROM counted),
known AS (SELECT w.*, CASE WHEN user_id IN (SELECT user_id FROM pro) THEN 1000000000 ELSE 15 END AS cap, (SELECT count(*) FROM live_category c WHERE c.user_id = w.user_id) AS own FROM wanted w),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, '' AS import_id, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS n, false AS fits, own AS at FROM known WHERE k = 1
  UNION ALL
  SELECT b.user_id, b.k, b.import_id, w.at, b.n, w.at + b.n <= b.cap, w.at + CASE WHEN w.at + b.n <= b.cap THEN b.n ELSE 0 END
  FROM walk w JOIN known b ON b.user_id = w.user_id AND b.k = w.k + 1)""", recursive=True, select="""
SELECT user_id, import_id, held, n AS wanted, fits AS accepted FROM walk WHERE k > 0""")


def _singly(resource: str, key: str, live: str, cap: int) -> str:
    return f"""SELECT '{resource}', user_id, batch, CASE WHEN pro THEN k - 1 ELSE least(k - 1, {cap}) END, 1, pro OR k <= {cap}
FROM (SELECT user_id, {key} AS batch, row_number() OVER (PARTITION BY user_id ORDER BY {key}) AS k, user_id IN (SELECT user_id FROM pro) AS pro FROM {live})"""


oracle("resource_limits", CATEGORY, LIVE_CATEGORY, ACCOUNT, LIVE_ACCOUNT, RULES, TXN, IMPORT, SUBSCRIPTION, PRO, """
loads AS (SELECT user_id, import_id, count(*) AS n, coalesce(list(DISTINCT "Category") FILTER ("Category" IS NOT NULL), []) AS names FROM import_row GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY import_id) AS k, user_id IN (SELECT user_id FROM pro) AS pro FROM loads),
posted AS (SELECT user_id, count(*) AS n FROM txn WHERE strftime(created_at, '%Y-%m') = '1998-07' GROUP BY ALL),
owned AS (SELECT user_id, count(*) AS n, list(name) AS names FROM live_category GROUP BY ALL),
rows_walk AS (
  SELECT p.user_id, CAST(0 AS BIGINT) AS k, '' AS import_id, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS n, false AS fits, CAST(coalesce(o.n, 0) AS BIGINT) AS at
  FROM placed p LEFT JOIN posted o ON o.user_id = p.user_id WHERE k = 1
  UNION ALL
  SELECT b.user_id, b.k, b.import_id, w.at, b.n, b.pro OR w.at + b.n <= 50, w.at + CASE WHEN b.pro OR w.at + b.n <= 50 THEN b.n ELSE 0 END
  FROM rows_walk w JOIN placed b ON b.user_id = w.user_id AND b.k = w.k + 1),
names_walk AS (
  SELECT p.user_id, CAST(0 AS BIGINT) AS k, '' AS import_id, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS n, false AS fits,
    CAST(coalesce(o.n, 0) AS BIGINT) AS at, coalesce(o.names, []) AS own
  FROM placed p LEFT JOIN owned o ON o.user_id = p.user_id WHERE k = 1
  UNION ALL
  SELECT user_id, k, import_id, s.at, CAST(len(brought) AS BIGINT), pro OR s.at + len(brought) <= 15, s.at + CASE WHEN pro OR s.at + len(brought) <= 15 THEN len(brought) ELSE 0 END,
    CASE WHEN pro OR s.at + len(brought) <= 15 THEN list_concat(own, brought) ELSE own END
  FROM (SELECT b.user_id, b.k, b.import_id, b.pro, w.at, w.own, list_filter(b.names, lambda x: NOT list_contains(w.own, x)) AS brought
    FROM names_walk w JOIN placed b ON b.user_id = w.user_id AND b.k = w.k + 1) s)""", recursive=True, select=f"""
SELECT 'transactions' AS resource, user_id, import_id AS batch, held, n AS wanted, fits AS accepted FROM rows_walk WHERE k > 0
UNION ALL SELECT 'categories', user_id, import_id, held, n, fits FROM names_walk WHERE k > 0
UNION ALL {_singly('accounts', 'account_id', 'live_account', 4)} UNION ALL {_singly('automations', 'rule_id', 'live_rule', 5)}""")

# -- statements --------------------------------------------------------------------------
STATEMENT_SLUG = 'CASE "Category" ' + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.STATEMENT_CATEGORIES.items()) + " ELSE 'other' END"
IMPORTED = f"""
filled AS (SELECT *, CAST(coalesce(try_strptime("Date", '%Y-%m-%d'), try_strptime("Date", '%-m/%-d/%Y')) AS DATE) AS d,
    abs(TRY_CAST(nullif(regexp_extract("Amount", '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DECIMAL(15,2))) AS amt,
    coalesce(nullif("Note", ''), "Category", '') || coalesce(' (' || "Labels" || ')', '') AS words, {STATEMENT_SLUG} AS slug,
    CASE WHEN contains(lower("Account"), 'bancolombia') THEN 'bancolombia' WHEN contains(lower("Account"), 'nequi') THEN 'nequi'
      WHEN contains(lower("Account"), 'cash') OR contains(lower("Account"), 'efectivo') THEN 'cash' ELSE 'bancolombia' END AS bank FROM import_row),
usual AS (SELECT user_id, institution, min_by(account_id, (name, account_id)) AS account_id FROM live_account GROUP BY ALL),
imported AS (SELECT import_id, row_id, d AS date, amt AS amount, upper(words[1]) || lower(words[2:]) AS description, f.slug AS category, o.category_id, u.account_id,
    concat_ws('; ', CASE WHEN d IS NULL THEN 'invalid date' END, CASE WHEN amt IS NULL THEN 'invalid amount' END,
      CASE WHEN amt <= 0 THEN 'amount not positive' END, CASE WHEN u.account_id IS NULL THEN 'no account' END) AS reasons
  FROM filled f LEFT JOIN usual u ON u.user_id = f.user_id AND u.institution = f.bank LEFT JOIN owned_category o ON o.user_id = f.user_id AND o.slug = f.slug)"""
oracle("csv_import", IMPORT, ACCOUNT, LIVE_ACCOUNT, OWNED_CATEGORY, IMPORTED, select="SELECT row_id, date, amount, description, category, category_id, account_id, reasons FROM imported")
oracle("import_audit", IMPORT, ACCOUNT, LIVE_ACCOUNT, OWNED_CATEGORY, IMPORTED, """
reasoned AS (SELECT import_id, split_part(reasons, '; ', 1) AS reason, count(*) AS n FROM imported GROUP BY ALL)""", select="""
SELECT import_id, CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (reason = ''), 0) AS BIGINT) AS imported_rows, CAST(coalesce(sum(n) FILTER (reason <> ''), 0) AS BIGINT) AS failed_rows,
  coalesce(string_agg(reason || ': ' || n, '; ' ORDER BY reason || ': ' || n) FILTER (reason <> ''), '') AS error_log,
  CASE WHEN sum(n) FILTER (reason = '') > 0 THEN 'completed' ELSE 'failed' END AS status FROM reasoned GROUP BY import_id""")
oracle("bulk_outcomes", MESSAGES, select="""
SELECT CASE WHEN NOT is_transaction THEN 'skipped' WHEN coalesce(amount, 0) <= 0 OR description = '' OR category = '' THEN 'error' ELSE 'success' END AS status, count(*) AS messages FROM parsed GROUP BY ALL""")

# -- quality and changes -----------------------------------------------------------------
oracle("constraint_violations", TXN, ACCOUNT, CATEGORY, RULES, SUBSCRIPTION, IMPORT, MESSAGE, """
odd AS (SELECT id, CASE WHEN seq % 19 = 0 THEN 'gift' ELSE type END AS type, CASE WHEN seq % 23 = 0 THEN -amount ELSE amount END AS amount,
  CASE WHEN seq % 29 <> 0 THEN account_id END AS account_id, confidence, seq FROM txn)""", select="""
SELECT 'transactions' AS table_name, id AS row_id, 'type in domain' AS rule, type AS value FROM odd WHERE type NOT IN ('expense', 'income', 'transfer')
UNION ALL SELECT 'transactions', id, 'amount positive', CAST(amount AS VARCHAR) FROM odd WHERE amount <= 0
UNION ALL SELECT 'transactions', id, 'confidence 0 to 100', CAST(confidence AS VARCHAR) FROM odd WHERE confidence NOT BETWEEN 0 AND 100
UNION ALL SELECT 'transactions', id, 'account given', NULL FROM odd WHERE account_id IS NULL
UNION ALL SELECT 'transactions', id, 'time given', NULL FROM odd WHERE seq % 31 = 0
UNION ALL SELECT 'transactions', id, 'payment method at most 50', repeat('x', 51) FROM odd WHERE seq % 37 = 0
UNION ALL SELECT 'accounts', account_id, 'last four at most 4', last_four || 'x' FROM account WHERE is_default AND length(last_four || 'x') > 4
UNION ALL SELECT 'categories', category_id, 'nature in domain', 'luxury' FROM category WHERE is_default
UNION ALL SELECT 'automation_rules', rule_id, 'name at most 200', repeat('n', 201) FROM rule WHERE priority = 100
UNION ALL SELECT 'automation_rules', rule_id, 'logic in domain', 'xor' FROM rule WHERE priority = 90
UNION ALL SELECT 'automation_rules', rule_id, 'actions given', NULL FROM rule WHERE priority = 80
UNION ALL SELECT 'subscriptions', CAST(user_id AS VARCHAR), 'plan in domain', 'gold' FROM subscription WHERE user_id % 7 = 3
UNION ALL SELECT 'reconciliations', account_id, 'status in domain', 'odd' FROM account WHERE CAST(account_id AS BIGINT) % 10 = 0
UNION ALL SELECT DISTINCT 'transaction_imports', import_id, 'status in domain', 'lost' FROM import_row WHERE import_id < '3'
UNION ALL SELECT 'skipped_messages', CAST(message_id AS VARCHAR), 'raw text given', NULL FROM message WHERE message_id % 7 = 0 AND text IS NULL""")
oracle("uniqueness_violations", CATEGORY, OFFERED, MESSAGE, select="""
SELECT 'categories' AS table_name, slug || '|' || CAST(user_id AS VARCHAR) AS key, count(*) AS rows FROM (SELECT user_id, slug FROM offer UNION ALL SELECT user_id, slug FROM category)
GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'usage_tracking', CAST(user_id AS VARCHAR) || '|' || strftime(received_at, '%Y-%m'), count(*) FROM message GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'api_keys', sha256(CAST(c_nationkey AS VARCHAR)), count(*) FROM customer GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'user_subscriptions', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL HAVING count(*) > 1""")


def _orphan(column: str, parent: str, key: str) -> str:
    return f"SELECT 'transactions' AS table_name, id AS row_id, '{column}' AS reference, {column} AS value FROM txn WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"


def _rule_orphan(column: str, value: str) -> str:
    return f"SELECT 'automation_rules', rule_id, '{column}', {value} FROM rule WHERE {value} NOT IN (SELECT account_id FROM live_account)"


oracle("orphan_rows", TXN, ACCOUNT, LIVE_ACCOUNT, CATEGORY, LIVE_CATEGORY, RULES, IMPORT, "kept AS (SELECT * FROM txn WHERE deleted_at IS NULL)", "loads AS (SELECT DISTINCT import_id FROM import_row WHERE import_id <> '5')", select=" UNION ALL ".join([
    _orphan("import_id", "loads", "import_id"), _rule_orphan("account_id", "json_extract_string(actions, '$.set_account')"), _rule_orphan("transfer_to_account_id", "transfer_to_account_id"),
    _orphan("account_id", "live_account", "account_id"), _orphan("category_id", "live_category", "category_id"),
    _orphan("duplicate_of", "kept", "id"), _orphan("transfer_to_account_id", "live_account", "account_id")]))
oracle("cascade_delete", TXN, ACCOUNT, "gone AS (SELECT account_id FROM account WHERE deleted_at IS NOT NULL)", select="""
SELECT id, account_id, CASE WHEN transfer_to_account_id NOT IN (SELECT account_id FROM gone) THEN transfer_to_account_id END AS transfer_to_account_id
FROM txn WHERE account_id NOT IN (SELECT account_id FROM gone)""")
oracle("cascade_imports", TXN, CATEGORY, select="""
SELECT id, CASE WHEN import_id >= '3' THEN import_id END AS import_id,
  CASE WHEN category_id NOT IN (SELECT category_id FROM category WHERE deleted_at IS NOT NULL) THEN category_id END AS category_id FROM txn""")
oracle("cascade_children", ACCOUNT, CATEGORY, select="""
SELECT 'rec-' || account_id AS id FROM account WHERE deleted_at IS NULL
UNION ALL SELECT 'cat-' || category_id FROM category WHERE parent_id IS NULL OR parent_id NOT IN (SELECT category_id FROM category WHERE parent_id IS NULL AND CAST(category_id[2:2] AS INT) % 2 = 0)""")
oracle("statement_file", IMPORT, select="""
SELECT row_id, CAST(coalesce(try_strptime("Date", '%Y-%m-%d'), try_strptime("Date", '%-m/%-d/%Y')) AS DATE) AS date,
  abs(TRY_CAST(nullif(regexp_extract("Amount", '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DECIMAL(15,2))) AS amount,
  'expense' AS type, 'cash' AS payment_method, 'import_csv' AS source, 100 AS confidence, "Category" AS raw_category FROM import_row""")
oracle("ledger_files", TXN, select="SELECT id, date, amount, description, updated_at > TIMESTAMP '1997-01-01 00:00:00' AS changed FROM txn")
oracle("soft_delete", TXN, select=f"""
SELECT id, CASE WHEN duplicate_status IS NOT NULL THEN coalesce(deleted_at, {TS}) ELSE deleted_at END AS deleted_at,
  CASE WHEN duplicate_status IS NOT NULL THEN {TS} ELSE updated_at END AS updated_at FROM txn""")
oracle("bulk_edit", TXN, select="""
SELECT id, CASE WHEN duplicate_status IS NOT NULL AND seq % 2 = 0 THEN 'income' ELSE type END AS type,
  CASE WHEN duplicate_status IS NOT NULL THEN '4' ELSE category_id END AS category_id, account_id FROM txn""")
oracle("duplicate_resolution", TXN, """
decided AS (SELECT *, CASE WHEN duplicate_status IS NOT NULL THEN CASE seq % 3 WHEN 0 THEN 'keep_both' WHEN 1 THEN 'delete_flagged' ELSE 'replace' END END AS decision FROM txn)""", select=f"""
SELECT id, CASE decision WHEN 'keep_both' THEN 'confirmed' WHEN 'replace' THEN NULL ELSE duplicate_status END AS duplicate_status,
  CASE WHEN decision = 'replace' THEN NULL ELSE duplicate_of END AS duplicate_of,
  CASE WHEN decision = 'delete_flagged' OR id IN (SELECT duplicate_of FROM decided WHERE decision = 'replace') THEN coalesce(deleted_at, {TS}) ELSE deleted_at END AS deleted_at FROM decided""")
oracle("balance_adjust", ACCOUNT, TXN, EFFECTS, """
target AS (SELECT effect_account_id AS account_id, CAST(greatest(sum(delta), 0) AS DECIMAL(15,2)) AS t FROM effect GROUP BY ALL),
moved AS (SELECT a.account_id, user_id, CAST(t - coalesce(balance, 0) AS DECIMAL(15,2)) AS d FROM target JOIN account a USING (account_id))""", select="""
SELECT account_id, user_id, abs(d) AS amount, CASE WHEN d > 0 THEN 'income' ELSE 'expense' END AS type, 'Balance adjustment' AS description FROM moved WHERE d <> 0""")
oracle("category_unlink", CATEGORY, TXN, """
asked AS (SELECT * FROM category WHERE spending_nature IN ('want', 'need')), roots AS (SELECT category_id FROM asked WHERE NOT is_default),
gone AS (SELECT category_id FROM roots UNION SELECT category_id FROM category WHERE parent_id IN (SELECT category_id FROM roots))""", select="""
SELECT id, CASE WHEN category_id NOT IN (SELECT category_id FROM gone) THEN category_id END AS category_id FROM txn
UNION ALL SELECT 'refused', category_id FROM asked WHERE is_default""")

# -- reports -----------------------------------------------------------------------------
oracle("net_worth", ACCOUNT, LIVE_ACCOUNT, select="SELECT user_id, CAST(sum(coalesce(balance, 0)) AS DECIMAL(38,2)) AS net_worth, count(*) AS accounts FROM live_account GROUP BY ALL")
KEPT = "kept AS (SELECT * FROM txn WHERE deleted_at IS NULL)"
oracle("month_summary", TXN, KEPT, """
sums AS (SELECT user_id, strftime(date, '%Y-%m') AS month, sum(CASE WHEN type = 'income' THEN amount ELSE 0 END) AS i, sum(CASE WHEN type = 'expense' THEN amount ELSE 0 END) AS e, count(*) AS n FROM kept GROUP BY ALL)""",
       select="SELECT user_id, month, CAST(i AS DECIMAL(38,2)) AS income, CAST(e AS DECIMAL(38,2)) AS expense, n AS transactions, CAST(i - e AS DECIMAL(38,2)) AS balance FROM sums")
SPENT = """
spent AS (SELECT user_id, t.category_id, CAST(sum(amount) AS DECIMAL(38,2)) AS spent, count(*) AS transactions, any_value(c.name) AS name, any_value(c.slug) AS slug
  FROM kept t LEFT JOIN (SELECT category_id, name, slug FROM category) c ON c.category_id = t.category_id WHERE type = 'expense' GROUP BY ALL)"""
oracle("spending_by_category", TXN, KEPT, CATEGORY, SPENT, select="SELECT * FROM spent")
oracle("category_counts", TXN, KEPT, CATEGORY, select="SELECT c.category_id, c.name, count(k.id) AS transactions FROM category c LEFT JOIN kept k ON k.category_id = c.category_id GROUP BY ALL")
oracle("recent_10", TXN, KEPT, select="""
SELECT id, user_id, date, time, amount FROM kept QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, time DESC, id) <= 10""")
oracle("top_categories", TXN, KEPT, CATEGORY, SPENT, select="""
SELECT user_id, category_id, name, spent FROM spent QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY spent DESC, category_id) <= 5""")
oracle("ledger_page", TXN, KEPT, select="""
SELECT id, date, amount FROM kept WHERE date < DATE '1998-06-30' OR (date = DATE '1998-06-30' AND id > '1') ORDER BY date DESC, id LIMIT 100""")
oracle("ledger_search", TXN, KEPT, select="""
SELECT id, date, type, amount FROM kept WHERE type IN ('expense', 'income') AND date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' AND contains(lower(description), 'restaurante')
UNION ALL SELECT id, date, type, amount FROM kept WHERE category_id = '7' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")


def _pesos(amount: str) -> str:
    return f"(CASE WHEN round({amount}, 0) < 0 THEN '-' ELSE '' END || '$' || chr(160) || replace(format('{{:,}}', CAST(abs(round({amount}, 0)) AS BIGINT)), ',', '.'))"


oracle("present_values", TXN, "signed AS (SELECT *, CASE WHEN seq % 7 = 0 THEN -amount ELSE amount END AS s FROM txn)", select=f"""
SELECT id, {_pesos('s')} AS shown_amount,
  array_to_string(list_transform(string_split(lower(description), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown_text,
  coalesce(CASE WHEN seq % 9 <> 0 THEN CAST(confidence + 1 AS VARCHAR) || '%' END, 'N/A') AS shown_confidence, strftime(date, '%d/%m/%Y') AS shown_date FROM signed""")
oracle("confirmations", MESSAGES, TIMED, DUP, ACCOUNT, """
shown AS (SELECT d.*, coalesce(a.balance, 0) AS shown_balance FROM dup d LEFT JOIN account a ON a.account_id = CAST(CAST(d.last_four AS INT) AS VARCHAR))""", select=f"""
SELECT id, CASE WHEN phone IS NOT NULL THEN concat_ws(chr(10), 'Internal Transfer', {_pesos('amount')}, 'Ahorro', 'To: ' || phone, strftime(date, '%d/%m/%Y') || ' ' || time, 'Balance: ' || {_pesos('shown_balance')})
  ELSE concat_ws(chr(10), 'Expense registered', {_pesos('amount')}, description, strftime(date, '%d/%m/%Y') || ' ' || time, category, bank || ' - ' || payment_type, 'Balance: ' || {_pesos('shown_balance')}) END AS confirmation
FROM shown""")

# -- the whole path ----------------------------------------------------------------------
FLOW = (
    MESSAGES, RULES, DETECTED, TIMED.replace("FROM parsed", "FROM detected"), """
banked AS (SELECT * REPLACE (CASE WHEN channel = 'email' THEN 'bancolombia' ELSE bank END AS bank, coalesce(source, parsed_source) AS source) FROM event)""",
    ACCOUNT, LIVE_ACCOUNT, cascade("banked"), FALLBACK, OWNED_CATEGORY, """
resolved AS (SELECT p.*, o.category_id, CASE WHEN NOT is_transaction THEN NULL WHEN coalesce(amount, 0) <= 0 THEN 'Invalid amount' WHEN description = '' THEN 'Missing description'
    WHEN date IS NULL THEN 'Invalid date' WHEN account_id IS NULL THEN 'No account' END AS reject
  FROM placed p LEFT JOIN owned_category o ON o.user_id = p.user_id AND o.slug = p.category),
good AS (SELECT * FROM resolved WHERE is_transaction AND reject IS NULL)""",
    legs("good", "account_id", "p_category", "CAST(NULL AS VARCHAR)",
         ", user_id, channel, source, date, time, text AS raw_text, received_at, account_id AS parsed_account_id").replace("SELECT p.*,", "SELECT p.*, p.category_id AS p_category,"),
    f"flow AS (SELECT *, {ID} AS id FROM legs)", applied("flow"), """
posted AS (SELECT w.* REPLACE (f.type AS type, f.category_id AS category_id, f.account_id AS account_id, f.transfer_to_account_id AS transfer_to_account_id,
    f.transfer_id AS transfer_id, f.notes AS notes) FROM flow w JOIN final f ON f.id = w.id),
sound AS (SELECT * FROM posted WHERE message_id NOT IN (SELECT message_id FROM posted WHERE account_id IS NULL))""",
)
oracle("ledger_posted", *FLOW, """
exact AS (SELECT n.id, min_by(s.id, (s.received_at, s.message_id, s.id)) AS exact_of FROM sound n JOIN sound s ON s.user_id = n.user_id AND s.source = n.source AND s.raw_text = n.raw_text
  AND (s.received_at, s.message_id) < (n.received_at, n.message_id) WHERE n.channel = 'api' GROUP BY n.id),
near AS (SELECT n.id, min_by(s.id, (s.received_at, s.message_id, s.id)) AS near_of FROM sound n JOIN sound s ON s.user_id = n.user_id AND s.date = n.date AND s.amount = n.amount
  AND s.account_id = n.parsed_account_id AND (s.received_at, s.message_id) < (n.received_at, n.message_id) WHERE n.channel = 'api' GROUP BY n.id)""",
       recursive=True, select="""
SELECT id, message_id, user_id, channel, source, date, time, amount, type, account_id, category_id, transfer_to_account_id, description, notes,
  CASE WHEN coalesce(exact_of, near_of) IS NOT NULL THEN 'pending_review' END AS duplicate_status, coalesce(exact_of, near_of) AS duplicate_of
FROM sound LEFT JOIN exact USING (id) LEFT JOIN near USING (id)""")
RECORD = """amount, CAST(confidence AS BIGINT) AS confidence, is_transaction, description, category, bank, payment_type, original_date, original_time,
  last_four, account_type, skip_reason, parsed_source"""
oracle("ledger_record", *FLOW, recursive=True, select=f"""
SELECT id, payment_type AS payment_method, p.text AS raw_text, {', '.join('p.' + c.strip() if '(' not in c else 'CAST(p.confidence AS BIGINT) AS confidence' for c in RECORD.split(','))}
FROM (SELECT id, message_id FROM sound) JOIN parsed p USING (message_id)""")
oracle("skipped_audit", MESSAGES, select=f"""
SELECT message_id, CASE channel WHEN 'chat' THEN 'telegram' WHEN 'parse' THEN 'api' ELSE source END AS stored_source, skip_reason AS reason, {RECORD} FROM parsed WHERE NOT is_transaction""")
oracle("ledger_rejects", *FLOW, recursive=True, select="""
SELECT message_id, channel, user_id, problem AS reason FROM shaped WHERE problem IS NOT NULL
UNION ALL SELECT message_id, channel, user_id, reject FROM resolved WHERE reject IS NOT NULL
UNION ALL SELECT DISTINCT message_id, channel, user_id, 'No destination account' FROM posted WHERE message_id IN (SELECT message_id FROM posted WHERE account_id IS NULL)""")

ADMITTED = """
numbered AS (SELECT *, strftime(received_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(received_at, '%Y-%m') ORDER BY received_at, message_id) AS n
  FROM shaped WHERE problem IS NULL),
judged AS (SELECT n.*, coalesce(u.ai_parses_used, 0) AS prior, EXISTS (SELECT 1 FROM subscription s WHERE s.user_id = n.user_id AND plan = 'pro' AND status = 'active') AS pro
  FROM numbered n LEFT JOIN usage_stored u ON u.user_id = n.user_id AND u.month = n.month)"""
oracle("preview_denied", SHAPE, USAGE, SUBSCRIPTION, ADMITTED, select="""
SELECT message_id, user_id, CAST(greatest(15, prior) AS BIGINT) AS used, CAST(15 AS BIGINT) AS "limit", 'PARSE_LIMIT_REACHED' AS reason FROM judged WHERE NOT pro AND prior + n > 15""")
oracle("preview_resolved", MESSAGES, USAGE, SUBSCRIPTION, ADMITTED, RULES, DETECTED, ACCOUNT, LIVE_ACCOUNT, OWNED_CATEGORY,
       "wanted AS (SELECT d.* REPLACE ('parse' AS channel) FROM detected d JOIN judged j ON j.message_id = d.message_id WHERE d.is_transaction AND (pro OR prior + n <= 15))",
       cascade("wanted"), FALLBACK, select=f"""
SELECT message_id, p.user_id, amount, category, coalesce({fix_date('original_date')}, original_date) AS original_date, account_id, o.category_id
FROM placed p LEFT JOIN owned_category o ON o.user_id = p.user_id AND o.slug = p.category""")

# -- streams: an available-now run over the whole table equals the batch result ------------
ORACLES["stream_ingest"] = ORACLES["ledger_posted"]
ORACLES["stream_dedup"] = ORACLES["ttl_cache_hits"]
ORACLES["stream_quota"] = ORACLES["quota_admission"]
oracle("stream_balances", TXN, EFFECTS, select="""
SELECT effect_account_id AS account_id, CAST(sum(delta) AS DECIMAL(38,2)) AS delta, count(*) AS effects FROM effect GROUP BY ALL""")
