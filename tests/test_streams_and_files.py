"""Streams over several files give the batch result; files survive a round trip."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywell.catalog import keyed_messages
from tallywell.operators import dedup, posting, sinks, statement, usage
from tallywell.plans import flows
from tallywell.sources import messages as src
from tallywell.sources import staging as st
from tallywell.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The events as three files, in arrival order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = st.raw(spark, SF, "events")
    for low, high in ((0, 350), (350, 700), (700, 10_000)):
        events.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, view):
    events = spark.readStream.schema(st.raw(spark, SF, "events").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return st.stage_from(spark, view, events=events)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


LEDGER = ["id", "date", "time", "amount", "type", "account_id", "category_id", "notes", "duplicate_status", "duplicate_of"]


def test_ingest_in_batches_equals_one_batch(spark, event_files, tmp_path):
    dims = (st.stage(spark, SF, "account"), st.slug_categories(spark, SF), st.rules(spark, SF))
    out = str(tmp_path)
    jobs.ingest_stream(src.by_channel(stream(spark, event_files, "message")), *dims, out, f"{out}/check").awaitTermination()
    whole = flows.ingest(src.by_channel(st.stage(spark, SF, "message")), *dims)
    ledger = spark.read.parquet(f"{out}/ledger")
    assert ledger.select("batch_id").distinct().count() == 3
    assert rows(ledger, *LEDGER) == rows(whole.ledger, *LEDGER)
    assert rows(spark.read.parquet(f"{out}/skipped"), "message_id", "reason") == rows(whole.skipped, "message_id", "reason")
    assert rows(spark.read.parquet(f"{out}/rejects"), "message_id", "reason") == rows(whole.rejects, "message_id", "reason")


def test_cache_in_batches_equals_one_batch(spark, event_files, tmp_path):
    out = str(tmp_path)
    jobs.cache_stream(keyed_messages(src.by_channel(stream(spark, event_files, "message")), st.rules(spark, SF)), out, f"{out}/check").awaitTermination()
    whole = dedup.cache_hits(keyed_messages(src.by_channel(st.stage(spark, SF, "message")), st.rules(spark, SF)))
    assert rows(spark.read.parquet(f"{out}/flagged"), "message_id", "cache_hit") == rows(whole, "message_id", "cache_hit")


def test_a_batch_is_dealt_out_before_it_is_keyed(spark, event_files, tmp_path):
    """A stream's files may have fewer splits than there are cores; keying parses every text."""
    out, seen, table = str(tmp_path), [], st.rules(spark, SF)

    def keyed(batch):
        seen.append(batch.rdd.getNumPartitions())
        return keyed_messages(batch, table)

    rows_in = src.by_channel(stream(spark, event_files, "message"))
    jobs.cache_stream(rows_in, out, f"{out}/check", keyed=keyed).awaitTermination()
    whole = dedup.cache_hits(keyed_messages(src.by_channel(st.stage(spark, SF, "message")), table))
    assert rows(spark.read.parquet(f"{out}/flagged"), "message_id", "cache_hit") == rows(whole, "message_id", "cache_hit")
    assert seen == [spark.sparkContext.defaultParallelism] * 3


def test_spread_bounds_the_rows_of_a_task(spark):
    cores = spark.sparkContext.defaultParallelism
    scan = spark.range(0, 3 * cores * src.TASK_ROWS, 1, cores)
    assert src.spread(scan).rdd.getNumPartitions() == 3 * cores
    assert src.spread(spark.range(0, 10, 1, cores)).rdd.getNumPartitions() == cores


def test_quota_in_batches_equals_one_batch(spark, event_files, tmp_path):
    out = str(tmp_path)
    dims = (st.stage(spark, SF, "usage_stored"), st.stage(spark, SF, "subscription"), st.settings(spark))
    jobs.quota_stream(stream(spark, event_files, "parse_request"), *dims, out, f"{out}/check").awaitTermination()
    whole = usage.quota_admission(st.stage(spark, SF, "parse_request"), *dims)
    columns = ["request_id", "month", "allowed", "used", "limit"]
    assert rows(spark.read.parquet(f"{out}/decided"), *columns) == rows(whole, *columns)


def test_balances_in_batches_equal_one_batch(spark, tmp_path):
    ledger, out = st.stage(spark, SF, "txn"), str(tmp_path)
    ledger.repartition(3).write.parquet(f"{out}/ledger")
    feed = jobs.change_feed(spark, f"{out}/ledger", ledger.schema, files_per_trigger=1)
    jobs.balance_stream(feed, out, f"{out}/check").awaitTermination()
    assert spark.read.parquet(f"{out}/changed").select("batch_id").distinct().count() == 3
    assert rows(jobs.latest_balances(spark, out), "account_id", "delta", "effects") == rows(posting.account_deltas(ledger), "account_id", "delta", "effects")


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    df = spark.range(5)
    sinks.write_batch(df, f"{tmp_path}/x", 0)
    sinks.write_batch(df, f"{tmp_path}/x", 0)
    assert spark.read.parquet(f"{tmp_path}/x").count() == 5
    assert jobs.earlier(spark, f"{tmp_path}/x", 0).count() == 0 and jobs.earlier(spark, f"{tmp_path}/none", 0) is None


def test_retention(spark, tmp_path):
    months = spark.createDataFrame([("2022-12",), ("2023-01",), ("2024-01",)], "month string")
    months.write.parquet(f"{tmp_path}/usage")
    jobs.run_retention(spark, f"{tmp_path}/usage", f"{tmp_path}/kept", F.lit("2024-01-31").cast("date"))
    assert sorted(r.month for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == ["2023-01", "2024-01"]


def test_json_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"message_id":1,"text":"20k pan","received_at":"2024-01-01T10:00:00"}\n{"message_id":2}\n')
    got = src.api_messages(src.read_messages(spark, str(tmp_path))).orderBy("message_id").collect()
    assert [(r.text, r.source, r.problem) for r in got] == [("20k pan", "api", None), (None, "api", "Missing text")]
    assert got[0].received_at == dt.datetime(2024, 1, 1, 10)
    assert src.stream_messages(spark, str(tmp_path)).isStreaming


def test_statement_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Amount,Category,Account,Note,Labels\n2024-01-05,-12.5,Rent,Nequi,renta DE enero,casa\n\nnever,7,Salary,Cash,,\n2024-01-06,0,X,Otra,,\nbad,row\n")
    read = src.read_statement(spark, str(tmp_path / "s.csv"))
    lined = read.withColumns({"import_id": F.lit("i"), "row_id": F.monotonically_increasing_id().cast("string"), "user_id": F.lit(0).cast("bigint")})
    done = statement.import_statement(lined, st.stage(spark, SF, "account"), st.slug_categories(spark, SF))
    good = statement.posted(done).collect()
    assert [(str(r.date), float(r.amount), r.description, r.time, r.confidence) for r in good] == [("2024-01-05", 12.5, "Renta de enero (casa)", "12:00:00", 100)]
    assert '"Note":"renta DE enero"' in good[0].raw_text
    assert {tuple(r.reasons)[0] for r in statement.rejected(done).collect()} == {"invalid date", "amount not positive", "corrupt row"}
    audit = statement.import_audit(done).head()
    assert (audit.total_rows, audit.imported_rows, audit.failed_rows, audit.status) == (4, 1, 3, "completed")


def test_ledger_files(spark, tmp_path):
    ledger = st.stage(spark, SF, "txn").withColumn("applied_rules", F.array(F.struct(F.lit("r").alias("rule_id"))))
    sinks.append_ledger(ledger, f"{tmp_path}/ledger")
    sinks.append_ledger(ledger.limit(0), f"{tmp_path}/ledger")
    back = spark.read.parquet(f"{tmp_path}/ledger")
    assert back.count() == ledger.count() and back.filter("month = '1997-05'").count() == ledger.filter("date_format(date, 'yyyy-MM') = '1997-05'").count()
    sinks.export_csv(ledger, f"{tmp_path}/csv")
    csv = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert csv.count() == ledger.count() and csv.head().applied_rules == '[{"rule_id":"r"}]'
    changed = sinks.changes_since(ledger, F.lit("1998-01-01").cast("timestamp_ntz"))
    assert 0 < changed.count() < ledger.count()


def test_side_tables(spark, tmp_path):
    done = flows.ingest(src.by_channel(st.stage(spark, SF, "message")), st.stage(spark, SF, "account"), st.slug_categories(spark, SF), st.rules(spark, SF))
    sinks.append_skipped(done.skipped, f"{tmp_path}/skipped")
    sinks.append_rejects(done.rejects, F.col("reason"), f"{tmp_path}/rejects")
    sinks.append_rules(st.rules(spark, SF).drop("ai_prompt"), f"{tmp_path}/rules")
    sinks.append_rules(st.rules(spark, SF).limit(0), f"{tmp_path}/rules")
    assert spark.read.parquet(f"{tmp_path}/skipped").count() == done.skipped.count() > 0
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == done.rejects.count() > 0
    assert spark.read.parquet(f"{tmp_path}/rules").filter("ai_prompt IS NOT NULL").count() == 0


def test_only_a_path_without_rows_is_a_first_batch(spark, tmp_path):
    assert jobs.earlier(spark, f"{tmp_path}/nothing", 3) is None
    (tmp_path / "empty").mkdir()
    assert jobs.earlier(spark, f"{tmp_path}/empty", 3) is None
    broken = tmp_path / "broken" / "batch_id=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        jobs.earlier(spark, f"{tmp_path}/broken", 3).count()


def test_a_batch_reads_the_index_folders_of_its_owners(spark, tmp_path):
    rows = spark.createDataFrame([(u, "x") for u in range(200)], "user_id bigint, raw_text string").withColumn("bucket", jobs.owner_bucket())
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{tmp_path}/index/batch_id=0")
    history = jobs.earlier(spark, f"{tmp_path}/index", 1)
    wanted = rows.filter("user_id = 7").select("bucket").head().bucket
    files = {f.split("bucket=")[1].split("/")[0] for f in history.filter(F.col("bucket").isin([wanted])).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert files == {str(wanted)} and len(history.inputFiles()) > 40
