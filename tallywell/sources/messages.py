"""Message scans: API, e-mail, chat, bulk lists and CSV statements, batch or stream.

Each reader shapes its channel's payload into the one message row; the ``*_messages``
functions take an already loaded DataFrame, so that a stream uses the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.fixed_values import (
    EMAIL_EXCERPT_CHARS,
    EMAIL_GATE,
    EMAIL_PATTERNS,
    REJECT_TEXT,
)
from tallywell.plans.once import once
from tallywell.schemas import MESSAGE, STATEMENT
from tallywell.functions.text import group1, wide_trim


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Messages as they arrive in a folder of JSON files."""
    reader = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; empty lines are skipped, malformed ones kept in ``_corrupt``."""
    return (
        spark.read.schema(STATEMENT)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A ledger or dimension table; filters and columns reach the Parquet scan."""
    return spark.read.parquet(path)


#: Rows that one task parses or applies rules to: some seconds' work, whatever the table's size.
TASK_ROWS = 50_000


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt out to tasks of at most about ``TASK_ROWS`` rows, and to every core at least.

    Parsing and rule application cost far more per row than moving the row, so neither should
    a few large row groups leave cores idle, nor a task grow with the table. A scan with
    enough splits is returned as it is. Only for scans, whose count is told by their files,
    and narrow steps over them: asking a plan with shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-scan.count() // TASK_ROWS))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


# -- API ---------------------------------------------------------------------------------
def api_messages(df: DataFrame) -> DataFrame:
    """Source defaults to 'api'; ``problem`` marks an empty text."""
    empty = F.coalesce("text", F.lit("")) == ""
    return df.withColumns(
        {
            "channel": F.lit("api"),
            "source": F.coalesce("source", F.lit("api")),
            "problem": F.when(empty, REJECT_TEXT),
        }
    )


# -- e-mail ------------------------------------------------------------------------------
def email_payload(body: Column, text: Column, subject: Column) -> Column:
    """The first non-empty of body, text and subject, else ''."""
    empty = F.lit("")
    return F.coalesce(F.nullif(body, empty), F.nullif(text, empty), F.nullif(subject, empty), empty)


def email_excerpt(body: Column) -> Column:
    """The bank's sentence: from the first pattern's hit, one line, at most 200 characters.

    Without a hit the first line that names the bank and holds a digit, dot or comma; NULL
    when there is none.
    """
    hit = F.coalesce(*[group1(body, p, 0) for p in EMAIL_PATTERNS])
    excerpt = F.substring(body, F.instr(body, hit), F.lit(EMAIL_EXCERPT_CHARS))
    first_line = F.get(F.split(excerpt, "\n"), F.lit(0))
    named = F.filter(
        F.split(body, "\n"),
        lambda line: F.contains(F.lower(line), F.lit(EMAIL_GATE)) & line.rlike(r"[\d,.]+"),
    )
    return F.when(hit.isNotNull(), first_line).otherwise(wide_trim(F.get(named, F.lit(0))))


def email_messages(df: DataFrame) -> DataFrame:
    """Text from the payload; ``problem`` is not_bancolombia or no_text_extracted."""
    payload = email_payload(F.col("body"), F.col("text"), F.col("subject"))
    gated = F.contains(F.lower("payload"), F.lit(EMAIL_GATE))
    return (
        df.withColumn("payload", payload)
        .withColumn("text", F.nullif(email_excerpt(F.col("payload")), F.lit("")))
        .withColumns(
            {
                "channel": F.lit("email"),
                "source": F.lit("bancolombia_email"),
                "problem": F.when(~gated, "not_bancolombia").when(
                    F.col("text").isNull(), "no_text_extracted"
                ),
            }
        )
        .drop("payload")
    )


# -- chat --------------------------------------------------------------------------------
COMMAND = r"^/(?:gasto|expense)(?:@\S+)?(?:\s|$)"
SERVICE = r"^/(?:start|help)(?:@\S+)?(?:\s|$)"
REJECT_SERVICE = "Service command"


def chat_text(text: Column) -> Column:
    """Plain text as it is; after a command word, what follows its first blank."""
    return F.when(text.rlike(COMMAND), F.regexp_extract(text, r"^[^ ]*(?: ([\s\S]*))?$", 1)).otherwise(text)


def chat_messages(df: DataFrame) -> DataFrame:
    body = chat_text(F.col("text"))
    return df.withColumns({"text": body}).withColumns(
        {
            "channel": F.lit("chat"),
            "problem": F.when(F.col("text").rlike(SERVICE), REJECT_SERVICE).when(F.coalesce("text", F.lit("")) == "", REJECT_TEXT),
        }
    )


# -- bulk lists --------------------------------------------------------------------------
def bulk_messages(df: DataFrame, column: str) -> DataFrame:
    """One row per message of a JSON array, a JSON object or newline-separated text.

    An object gives its ``messages`` list, else all its values. Blank lines are dropped from
    plain text only.
    """
    raw = F.col(column)
    clean = F.trim(raw)
    as_array = F.from_json(clean, "array<string>")
    as_object = F.from_json(clean, "map<string,string>")
    listed = F.from_json(F.try_element_at(as_object, F.lit("messages")), "array<string>")
    lines = F.filter(F.split(raw, "\n"), lambda line: wide_trim(line) != "")
    texts = (
        F.when(F.startswith(clean, F.lit("[")), as_array)
        .when(F.startswith(clean, F.lit("{")), F.coalesce(listed, F.map_values(as_object)))
        .otherwise(lines)
    )
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(texts).alias("position", "text")).withColumns(
        {"channel": F.lit("bulk"), "source": F.lit("sms-bulk")}
    )


# -- all channels ------------------------------------------------------------------------
SHAPE = ["message_id", "channel", "user_id", "text", "source", "received_at", "problem"]


def by_channel(messages: DataFrame) -> DataFrame:
    """Shape mixed messages by their ``channel`` column, in one pass over them."""
    channel = F.col("channel")
    payload = email_payload(F.col("body"), F.col("text"), F.col("subject"))
    email = channel == "email"
    excerpt = F.nullif(email_excerpt(F.col("payload")), F.lit(""))
    text = F.when(email, excerpt).when(channel == "chat", chat_text(F.col("text")))
    shaped = once(
        messages.withColumn("payload", F.when(email, payload)), {"text": text.otherwise(F.col("text"))}
    )
    gated = F.contains(F.lower("payload"), F.lit(EMAIL_GATE))
    empty = F.coalesce("text", F.lit("")) == ""
    return shaped.withColumns(
        {
            "source": F.when(email, "bancolombia_email")
            .when(channel == "bulk", "sms-bulk")
            .when(channel == "chat", F.lit(None).cast("string"))
            .otherwise(F.coalesce("source", F.lit("api"))),
            "problem": F.when(email & ~gated, "not_bancolombia")
            .when(email & F.col("text").isNull(), "no_text_extracted")
            .when((channel == "chat") & F.col("text").rlike(SERVICE), REJECT_SERVICE)
            .when(empty, REJECT_TEXT),
        }
    ).select(*SHAPE)


def union_channels(*channels: DataFrame) -> DataFrame:
    """All channels as one table; columns a channel lacks become NULL."""
    out = channels[0]
    for other in channels[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select(*[c for c in SHAPE if c in out.columns])
