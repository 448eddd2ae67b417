"""Row types of the ledger tables."""

from __future__ import annotations

MONEY = "decimal(15,2)"

MESSAGE = (
    "message_id bigint, channel string, user_id bigint, text string, body string, "
    "subject string, source string, received_at timestamp_ntz"
)
PARSED_EXPENSE = (
    f"amount {MONEY}, description string, category string, bank string, payment_type string, "
    "source string, confidence int, original_date string, original_time string, "
    "last_four string, account_type string, is_transaction boolean, skip_reason string"
)
ACCOUNT = (
    "account_id string, user_id bigint, name string, type string, institution string, "
    f"last_four string, currency string, balance {MONEY}, is_active boolean, "
    "is_default boolean, deleted_at date"
)
CATEGORY = (
    "category_id string, user_id bigint, name string, slug string, type string, "
    "parent_id string, is_active boolean, is_default boolean, spending_nature string, "
    "translations map<string,string>, deleted_at date"
)
RULE = (
    "rule_id string, user_id bigint, name string, is_active boolean, priority int, "
    "prompt_text string, match_phone string, transfer_to_account_id string, rule_type string, "
    "condition_logic string, conditions string, actions string, ai_prompt string, "
    "deleted_at date"
)
CONDITIONS = (
    "description_contains array<string>, description_regex string, "
    "raw_text_contains array<string>, amount_between array<decimal(30,10)>, "
    "amount_equals decimal(30,10), from_account string, to_account string, "
    "source array<string>, category string"
)
ACTIONS = (
    "set_type string, set_category string, set_account string, link_to_account string, "
    "auto_reconcile boolean, add_note string"
)
APPLIED_RULES = "array<struct<rule_id:string,rule_name:string,actions:string>>"
STATEMENT = (
    "Date string, Amount string, Category string, Account string, Note string, Labels string, "
    "_corrupt string"
)
GENERATED_RULE = (
    "name string, is_active boolean, priority int, rule_type string, condition_logic string, "
    "conditions string, actions string"
)
