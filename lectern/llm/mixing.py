"""Problem 9: mixing sources to target weights.

Method: tokens are aggregated per source, repetition rates derived, and each document
is emitted floor(rate) times plus once more if its hash-seeded Bernoulli draw, of
probability rate - floor(rate), succeeds.

The targets of sources that have tokens are scaled to sum to 1 (a source without
documents can't be had).  The total is the largest at which no source exceeds its
``max_repeats``, so every share is met in expectation; a larger ``total_tokens`` is
reached as far as the caps allow.  Sources without a target row, and documents without a
source, are left out: their target is 0.  Null and empty texts count 0 tokens and are
emitted like others.  A source listed twice in the targets counts with the sum of its
shares and the least cap; null shares or caps count as 0.  The same seed gives the same copies
on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import TOKENIZERS, counted
from lectern.session import materialize


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, rate) of each target; sizes: source, n_tokens per document."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goal = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    both = goal.join(per, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    able = (F.col("n_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    sums = both.where(able).agg(F.sum("target_share").alias("reachable"), F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")).alias("most"))
    total = F.col("most") * F.col("reachable") if total_tokens is None else F.lit(float(total_tokens))
    rate = F.when(able, F.least(F.col("max_repeats").cast("double"), total * F.col("target_share") / F.col("reachable") / F.col("n_tokens"))).otherwise(0.0)
    return both.crossJoin(F.broadcast(sums)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", rate.alias("rate"))


def sized(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens), written once: the rates and the copies both read it.

    Rows of one id are one document: their texts add up, and of their sources it has the least."""
    return materialize(df.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source")).join(counted(df, "doc_id", "text", name, folder), "doc_id"), "sizes")


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, copy, n_tokens): one row per emitted copy, copies numbered from 1."""
    rate = rates(sizes, targets, total_tokens).select("source", "rate")
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(2**53))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    chosen = sizes.join(rate, "source").withColumn("copies", copies).where("copies > 0")
    return chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_tokens")


def shares(sizes: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None) -> DataFrame:
    """What each target got: documents, tokens, rate, emitted copies and tokens, actual share (0 where nothing was emitted)."""
    got = mixed(sizes, targets, seed, total_tokens).groupBy("source").agg(F.count("*").alias("n_copies"), F.sum("n_tokens").alias("mixed_tokens"))
    report = rates(sizes, targets, total_tokens).join(got, "source", "left").fillna(0, ["n_copies", "mixed_tokens"])
    total = report.agg(F.sum("mixed_tokens").alias("total"))
    return report.crossJoin(F.broadcast(total)).withColumn("actual_share", F.when(F.col("total") > 0, F.col("mixed_tokens") / F.col("total")).otherwise(0.0)).drop("total")
