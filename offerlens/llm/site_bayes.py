"""Quality by hierarchical empirical Bayes over hosts and paths.

A document's own evidence is the calibrated probability of a text classifier. Sums
of it over a host and over a path below the host are shrunk: a host towards the
global rate, a path towards its host, each by a prior strength that is estimated
from how much the rates differ beyond chance. The path's posterior rate replaces the
global prior in the document's log odds.

Only sums are grouped, so a host with a third of all rows costs one partial sum per
task. A null host or path is a group of its own. A null text has no evidence: it gets
the posterior of its path and is not kept. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import map_batches, raw_texts
from offerlens.llm.quality import Model

KEEP_AT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6


def evidence(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``logit``, null where there is no text to judge."""
    fields = [df.schema[c] for c in keep]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = raw_texts(batch.column(len(keep)))
            logits = [float(np.clip(model.logit(t), -20, 20)) if t.strip() else None for t in rows]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(logits, pa.float64())], [*keep, "logit"])

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", logit double"
    return map_batches(df.select(*keep, text), make, schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame) -> DataFrame:
    """Beta prior strength by moments, from (rate, prior, n): the spread of the rates
    around their priors less what chance explains."""
    w = F.col("n")
    spread = F.sum(w * F.pow(F.col("rate") - F.col("prior"), 2)) / F.sum(w)
    chance = F.sum(F.col("prior") * (1 - F.col("prior"))) / F.sum(w)
    unit = F.sum(w * F.col("prior") * (1 - F.col("prior"))) / F.sum(w)
    # spread = unit / (strength + 1) * (1 - 1/n) + chance
    between = F.greatest(spread - chance, F.lit(0.0))
    found = F.when(between > 0, unit / between - 1).otherwise(F.lit(MOST_STRENGTH))
    return rates.agg(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.coalesce(found, F.lit(LEAST_STRENGTH)))).alias("strength"))


def site_rates(scores: DataFrame, host: str, path: str) -> DataFrame:
    """Per host and path: the numbers of documents, and the posterior rates."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = scores.groupBy(F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path")).agg(
        F.count("logit").alias("n"), F.coalesce(F.sum(p), F.lit(0.0)).alias("good")
    )
    total = paths.agg(F.coalesce(F.sum("good") / F.sum("n"), F.lit(0.5)).alias("global_rate"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    hosts = hosts.crossJoin(F.broadcast(total))  # one row
    rated = hosts.filter("host_n > 0").select((F.col("host_good") / F.col("host_n")).alias("rate"), F.col("global_rate").alias("prior"), F.col("host_n").alias("n"))
    hosts = hosts.crossJoin(F.broadcast(_strength(rated).withColumnRenamed("strength", "host_strength")))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + F.col("host_strength") * F.col("global_rate")) / (F.col("host_n") + F.col("host_strength")))
    hosts = hosts.withColumnRenamed("host", "of_host")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    rated = joined.filter("n > 0").select((F.col("good") / F.col("n")).alias("rate"), F.col("host_rate").alias("prior"), "n")
    joined = joined.crossJoin(F.broadcast(_strength(rated).withColumnRenamed("strength", "path_strength")))
    rate = (F.col("good") + F.col("path_strength") * F.col("host_rate")) / (F.col("n") + F.col("path_strength"))
    return joined.select("host", "path", "n", "host_n", "global_rate", "host_rate", rate.alias("path_rate"))


def posterior(
    scores: DataFrame, host: str, path: str, keep_at: float = KEEP_AT,
) -> DataFrame:
    """``scores`` with the rates of its host and path, ``posterior`` and ``kept``."""
    rates = site_rates(scores, host, path).withColumnsRenamed({"host": "__host", "path": "__path", "n": "path_n"})
    joined = scores.join(
        rates, F.col(f"`{host}`").eqNullSafe(F.col("__host")) & F.col(f"`{path}`").eqNullSafe(F.col("__path")), "left"
    ).drop("__host", "__path")
    log_odds = F.coalesce(F.col("logit"), _logit(F.col("global_rate"))) - _logit(F.col("global_rate")) + _logit(F.col("path_rate"))
    p = 1 / (1 + F.exp(-log_odds))
    return joined.withColumn("posterior", p).withColumn("kept", F.col("logit").isNotNull() & (p >= F.lit(keep_at)))
