"""Session memory, usage logs and what is tuned from them.  Rows of a repeated id count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, most: int = 10, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``most`` turns of each session, newest first as ``age`` 1."""
    once = turns.groupBy(session, order).agg(F.min("role").alias("role"), F.min("text").alias("text"))
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return once.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def sessions(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.groupBy(session).agg(F.countDistinct(order).alias("n_turns"), F.max(order).alias("last_turn"))


def history_blocks(turns: DataFrame, most: int = 4, chars: int = 120, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, history): the last turns as lines for a prompt."""
    rows = last_turns(turns, most, session, order).select(session, order, F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars)).alias("line"))
    return rows.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("history"))


def distinct_usage(log: DataFrame) -> DataFrame:
    """One row per ``usage_id``: the one logged first (ties by the least text)."""
    rest = [c for c in log.columns if c != "usage_id"]
    pick = F.min_by(F.struct(*rest), F.struct("logged_at", F.coalesce("text", F.lit(""))))
    return log.where("usage_id is not null").groupBy("usage_id").agg(pick.alias("r")).select("usage_id", "r.*")


def tail(log: DataFrame, most: int, *order: Column) -> DataFrame:
    """The last rows: a sort that keeps ``most`` rows per task."""
    return log.orderBy(*order).limit(most)


def tuned(log: DataFrame, every: int = 10, min_score: float = 0.2, history: int = 50) -> DataFrame:
    """(block, n, unknown_rate, avg_latency, min_score, history): each ``every`` interactions, in order of ``usage_id``, what the settings should become.

    Blocks are ranges of ids, so no order over all rows is needed."""
    once = distinct_usage(log).where("latency_ms >= 0")
    per = once.groupBy(F.floor((F.col("usage_id") - 1) / every).alias("block")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.coalesce("mode", F.lit("unknown")) == "unknown").cast("double")), 6).alias("unknown_rate"), F.round(F.sum(F.round(F.col("latency_ms") * 100).cast("long")) / 100.0 / F.count("*"), 6).alias("avg_latency")
    )
    score = F.when(F.col("unknown_rate") > 0.4, F.greatest(F.lit(0.1), F.lit(min_score) - 0.05)).otherwise(min_score)
    keep = F.when(F.col("avg_latency") > 200, max(10, history - 10)).when((F.col("avg_latency") < 50) & (F.lit(history) < 500), history + 20).otherwise(history)
    return per.select("block", "n", "unknown_rate", "avg_latency", F.round(score, 4).alias("min_score"), keep.alias("history"))


def by_mode(log: DataFrame) -> DataFrame:
    once = distinct_usage(log)
    return once.groupBy(F.coalesce("mode", F.lit("")).alias("mode")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


def gaps(log: DataFrame, most: int = 200) -> DataFrame:
    """The latest questions that found nothing."""
    lost = distinct_usage(log).where(F.coalesce("score", F.lit(0.0)) <= 0.06).select("usage_id", "ts", "text")
    return tail(lost, most, F.desc("ts"), F.desc("usage_id"))


def tier(cores: Column, ram_gb: Column) -> Column:
    """Size class of a machine."""
    return F.when((ram_gb < 2) | (cores <= 2), "low").when((ram_gb < 8) | (cores <= 4), "medium").otherwise("high")


def suggestions(log: DataFrame, recent: int = 50, unknown: float = 0.3, topics: int = 3) -> DataFrame:
    """(kind, share, n, topics): what the last ``recent`` questions say: 'usage' if more than ``unknown`` of them found no answer, 'knowledge' with the latest topics that found nothing."""
    once = distinct_usage(log)
    last = tail(once, recent, F.desc("logged_at"), F.desc("usage_id"))
    usage = last.agg(F.round(F.avg((F.coalesce("mode", F.lit("unknown")) == "unknown").cast("double")), 4).alias("share"), F.count("*").alias("n")).where(F.col("share") > unknown)
    lost = tail(once.where((F.coalesce("score", F.lit(0.0)) <= 0.06) & F.col("text").isNotNull()).select("usage_id", "ts", "text"), topics, F.desc("ts"), F.desc("usage_id"))
    named = lost.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "usage_id", "text"))), lambda x: x["text"]), "; ").alias("topics")).where("n > 0")
    return usage.select(F.lit("usage").alias("kind"), "share", "n", F.lit("").alias("topics")).union(named.select(F.lit("knowledge"), F.lit(None).cast("double"), "n", "topics"))


#: Passages that a GB of memory holds; aimed at latency in milliseconds.
PASSAGES_A_GB, LATENCY = 30_000, 80.0


def advice(machines: DataFrame, passages: int, log: DataFrame | None = None) -> DataFrame:
    """(machine, priority, note): what each machine (machine, cores, ram_gb, free_gb) lacks for a collection of so many passages, most urgent first."""
    need = passages / PASSAGES_A_GB
    notes = [
        (1, "memory", F.col("free_gb") < 0.5), (2, "capacity", F.col("ram_gb") < need), (3, "cores", F.col("cores") <= 2), (4, "headroom", (F.col("ram_gb") >= need) & (F.col("ram_gb") < 1.5 * need)),
    ]
    if log is not None:
        slow = distinct_usage(log).where("latency_ms >= 0").agg(F.avg("latency_ms").alias("latency"))
        machines = machines.crossJoin(F.broadcast(slow))
        notes.append((2, "latency", F.col("latency") > LATENCY))
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(p).alias("priority"), F.lit(n).alias("note"))) for p, n, cond in notes]))
    return machines.select("machine", F.explode(F.sort_array(found)).alias("x")).select("machine", "x.priority", "x.note")
