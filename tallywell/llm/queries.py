"""The registered queries of the corpus operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywell.llm import anchor_codes, boosting, lexicon, licenses, mixing, nn_descent, packing, pii, randomness, role_repair, sharding, sketch_dedup, telephony

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op8_sketch_dedup(spark, sf):
    return sketch_dedup.near_duplicates(read(spark, sf, "documents"), words=2, percent=80)


@query
def op1_telephony(spark, sf):
    return telephony.transcoded(read(spark, sf, "documents"))


@query
def op2_jump_shards(spark, sf):
    return sharding.sharded(read(spark, sf, "documents"), shards=40)


@query
def op3_vector_packing(spark, sf):
    return packing.packed(read(spark, sf, "documents"), capacity=2048)


@query
def op4_boosted_quality(spark, sf):
    docs = read(spark, sf, "documents")
    return boosting.scored(docs, boosting.fitted(docs, read(spark, sf, "labels")))


@query
def op9_randomness_secrets(spark, sf):
    return randomness.scanned(read(spark, sf, "documents"))


@query
def op10_bilstm_pii(spark, sf):
    docs = read(spark, sf, "documents")
    return pii.scanned(docs, pii.fitted(docs))


@query
def op5_licence_dice(spark, sf):
    return licenses.scanned(read(spark, sf, "documents"))


ORACLES["op5_licence_dice"] = licenses.oracle()


@query
def op6_source_mixture(spark, sf):
    return mixing.mixed(read(spark, sf, "documents"))


ORACLES["op6_source_mixture"] = mixing.oracle()


@query
def op7_nn_descent(spark, sf):
    return nn_descent.near_duplicates(read(spark, sf, "embeddings"), threshold=0.95)


@query
def op11_anchor_codes(spark, sf):
    return anchor_codes.coded(read(spark, sf, "embeddings"))


@query
def op12_role_repair(spark, sf):
    conversations = read(spark, sf, "conversations")
    return role_repair.summaries(conversations, role_repair.damaged(conversations))


@query
def op13_transducer_lexicon(spark, sf):
    return lexicon.encoded(read(spark, sf, "documents"))
