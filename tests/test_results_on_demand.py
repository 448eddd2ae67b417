"""A reader of one result pays for no other, and many accounts are grouped only where messages ask for them."""

from pyspark.sql import functions as F

from tallywell import catalog
from tallywell.operators import parse, resolve
from tallywell.plans import flows

SF = "/root/testdata/sf0.001"


def test_denied_requests_are_not_parsed(spark, monkeypatch):
    def never(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(parse, "parse_messages", never)
    assert catalog.preview_denied(spark, SF).count() > 0


def test_rejects_post_nothing(spark, monkeypatch):
    written, write = [], flows.materialise

    def noted(df, purpose):
        written.append(purpose)
        return write(df, purpose)

    monkeypatch.setattr(flows, "materialise", noted)
    done = catalog.ingested(spark, SF)
    alone = sorted(map(tuple, done.rejects.collect()), key=str)
    assert "posted" not in written
    both = catalog.ingested(spark, SF)
    assert both.ledger.count() > 0 and "posted" in written
    assert sorted(map(tuple, both.rejects.collect()), key=str) == alone


def test_many_accounts_are_met_by_few_combinations(spark, monkeypatch):
    accounts = catalog.st.stage(spark, SF, "account")
    rows = spark.createDataFrame(
        [(i, i % 25, bank, four, kind) for i, (bank, four, kind) in enumerate(
            [("bancolombia", "0004", "savings"), ("nequi", None, "cash"), (None, "0001", None), ("cash", "0003", None)] * 10)],
        "message_id int, user_id bigint, bank string, last_four string, account_type string")

    def got():
        return sorted(map(tuple, resolve.resolve_accounts(rows, accounts).select("message_id", "cascade_account_id", "cascade_tier").collect()))

    want, grouped, first_id = got(), [], resolve._first_id

    def noted(df, keys, *rest):
        grouped.append(df.count())
        return first_id(df, keys, *rest)

    monkeypatch.setattr(resolve, "is_small", lambda df: "name" not in df.columns)
    monkeypatch.setattr(resolve, "_first_id", noted)
    assert got() == want
    assert max(grouped) < resolve.live(accounts).count()
    assert any(tier is not None for _, _, tier in want)
