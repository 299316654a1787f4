"""Early-warning rules on arrival times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def recent_and_prior(times: DataFrame, kind: str, now: int) -> DataFrame:
    """(kind, recent, prior): rows of the last 24 hours and of those before; future and unknown times count for nothing."""
    age = F.lit(now) - F.col("at_s")
    return times.agg(F.count_if((age >= 0) & (age <= DAY)).alias("recent"), F.count_if((age > DAY) & (age <= 2 * DAY)).alias("prior")).select(F.lit(kind).alias("kind"), "recent", "prior")


def snapshot_alerts(counts: DataFrame) -> DataFrame:
    """Alerts whose recent count reaches its floor and twice the prior one; one QUIET row if none does."""
    rules = [("INGESTION_SPIKE", 5, "warn"), ("DISPUTED_SURGE", 3, "warn"), ("MUTATION_SURGE", 3, "critical")]
    rules = counts.sparkSession.createDataFrame(rules, "kind string, floor int, severity string")
    raised = counts.join(F.broadcast(rules), "kind").where((F.col("recent") >= F.col("floor")) & (F.col("recent") >= 2 * F.greatest("prior", F.lit(1)))).select("kind", "severity", "recent", "prior")
    quiet = counts.sparkSession.range(1).select(F.lit("QUIET").alias("kind"), F.lit("info").alias("severity"))
    total = raised.agg(F.count("*").alias("n"))
    quiet = quiet.crossJoin(total).where("n = 0").select("kind", "severity", F.lit(0).cast("long").alias("recent"), F.lit(0).cast("long").alias("prior"))
    return raised.union(quiet)


CONTRADICTED, CORROBORATED, BURST = 0.3, 0.6, 8
MAX_ALERTS = 40


def conditions(claims: DataFrame, signals: DataFrame, changes: DataFrame, clusters: DataFrame, since: int, most: int = MAX_ALERTS) -> DataFrame:
    """(kind, severity, subject_key) of what was seen since then, `most` at most: claims first (newest first), then
    changes (newest first), then bursts (largest first).

    claims: (claim_id, extracted_s). signals: (claim_id, ratio, corroboration): a contradicted share of at least .3 is
    critical, else a corroboration of at least .6 is noted. changes: (from_id, to_id, created_s, types, meaningful) of
    evolved edges: a warning if numbers or polarity changed. clusters: (claim_id, run, topic): topics with at least 8
    new claims.
    """
    new = claims.where(F.col("extracted_s") >= since)
    kind = F.when(F.col("ratio") >= CONTRADICTED, "CONTRADICTION").when(F.col("corroboration") >= CORROBORATED, "CORROBORATION")
    backed = new.join(signals, "claim_id").withColumn("kind", kind).where("kind is not null")
    severity = F.when(F.col("kind") == "CONTRADICTION", "CRITICAL").otherwise("INFO")
    key = F.concat(F.lit("claim:"), F.col("claim_id").cast("string"))
    first = backed.select(F.lit(1).alias("turn"), (-F.col("extracted_s")).alias("by"), "kind", severity.alias("severity"), key.alias("subject_key"))
    typed = changes.where((F.col("created_s") >= since) & F.col("meaningful") & (F.col("types") != ""))
    severity = F.when(F.col("types").contains("NUMERIC_DRIFT") | F.col("types").contains("POLARITY_SHIFT"), "WARNING").otherwise("INFO")
    key = F.concat_ws(":", F.lit("edge"), F.col("from_id").cast("string"), F.col("to_id").cast("string"))
    second = typed.select(F.lit(2).alias("turn"), (-F.col("created_s")).alias("by"), F.lit("MUTATION").alias("kind"), severity.alias("severity"), key.alias("subject_key"))
    bursts = new.join(clusters, "claim_id").groupBy("run", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= BURST)
    key = F.concat_ws(":", F.lit("cluster"), F.col("run").cast("string"), F.col("topic").cast("string"))
    third = bursts.select(F.lit(3).alias("turn"), (-F.col("n")).alias("by"), F.lit("SPIKE").alias("kind"), F.lit("WARNING").alias("severity"), key.alias("subject_key"))
    raised = first.unionByName(second).unionByName(third)
    return raised.orderBy("turn", "by", "subject_key").limit(most).select("kind", "severity", "subject_key")


def feed(alerts: DataFrame, limit: int, kind: str | None = None, severity: str | None = None, include_acknowledged: bool = False) -> DataFrame:
    """The newest alerts (kind, severity, subject_key, last_seen_s, acknowledged_s), of one kind or severity if named."""
    rows = alerts if include_acknowledged else alerts.where("acknowledged_s is null")
    for column, wanted in (("kind", kind), ("severity", severity)):
        rows = rows.where(F.col(column) == wanted.strip().upper()) if wanted else rows
    return rows.orderBy(F.desc_nulls_last("last_seen_s"), "kind", "subject_key").limit(limit)


def tallies(alerts: DataFrame) -> DataFrame:
    """(part, name, n): how many alerts nobody has acknowledged, in all, by severity and by kind."""
    waiting = alerts.where("acknowledged_s is null")
    one = lambda part, name: waiting.groupBy(F.lit(part).alias("part"), name.alias("name")).agg(F.count("*").alias("n"))
    return one("all", F.lit("unacknowledged")).unionByName(one("severity", F.col("severity"))).unionByName(one("kind", F.col("kind")))
