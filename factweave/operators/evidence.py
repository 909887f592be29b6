"""Evidence for an answer, and which of its claims have none. No model is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_LOG = "call_id string, provider string, model string, task string, latency_ms long, prompt_tokens long, completion_tokens long, called_at timestamp"


def inventory(sources: dict[str, DataFrame]) -> DataFrame:
    """(evidence_type, n_items, is_missing) of each kind of evidence."""
    out = None
    for name, df in sources.items():
        one = df.agg(F.lit(name).alias("evidence_type"), F.count("*").alias("n_items"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_missing", F.col("n_items") == 0)


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, n_cited, n_found, is_supported): a claim needs at least one citation, and all must exist."""
    cited = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = evidence.select("evidence_id").distinct().withColumn("_known", F.lit(1))
    rows = cited.join(known, "evidence_id", "left").groupBy("claim_id").agg(F.count("evidence_id").alias("n_cited"), F.count("_known").alias("n_found"))
    return rows.withColumn("is_supported", (F.col("n_cited") > 0) & (F.col("n_cited") == F.col("n_found")))


def answer_sections(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, line) of a labelled answer."""
    out = None
    for section, df in parts.items():
        one = df.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def call_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("provider", "model", "task").agg(
        F.count("*").alias("n_calls"), F.avg("latency_ms").alias("mean_latency_ms"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("n_tokens")
    )
