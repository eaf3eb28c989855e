"""Hotspot scores, ranks and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.functions.text import clamp, finite, path_filter, percent_g

FOCUSED, DEPRIORITIZED = 1.25, 0.55


def maxima(nodes: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the maximum of every metric (0 without nodes)."""
    return nodes.agg(*[F.coalesce(F.max(F.col(m).cast("double")), F.lit(0.0)).alias(f"max_{m}") for m in metrics])


def score(weights: dict[str, float]) -> Column:
    """Weighted mean of value / maximum over the metrics that are positive; null where none is."""
    num, den = F.lit(0.0), F.lit(0.0)
    for m, w in weights.items():
        up = F.col(m) > 0
        num += F.when(up & (F.col(f"max_{m}") > 0), F.col(m).cast("double") / F.col(f"max_{m}") * w).otherwise(0.0)
        den += F.when(up, w).otherwise(0.0)
    return F.when(den > 0, num / den)


def with_score(nodes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Nodes with raw_score; those without a positive metric go.  The maxima are one broadcast row."""
    scored = nodes.crossJoin(F.broadcast(maxima(nodes, list(weights)))).withColumn("raw_score", score(weights))
    return scored.where("raw_score IS NOT NULL")


def starts_under(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in map(path_filter, prefixes):
        if p:
            out = out | (path == p.rstrip("/")) | path.startswith(p)
    return out


def priority_label(path: Column, focus: list[str], deprioritized: list[str]) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")
    return F.when(starts_under(p, focus), "focused").when(starts_under(p, deprioritized), "deprioritized").otherwise("neutral")


def adjusted(raw: Column, label: Column) -> Column:
    by = F.when(label == "focused", FOCUSED).when(label == "deprioritized", DEPRIORITIZED).otherwise(1.0)
    return F.round(clamp(raw * by), 4)


def top_ranked(scored: DataFrame, k: int, *tie: str, by: str = "score") -> DataFrame:
    """The k highest with rank from 1; ties by the given columns.  Only k rows meet in one task."""
    first = scored.orderBy(F.desc(by), *tie).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), *tie)))


def all_ranked(scored: DataFrame, *tie: str, by: str = "score") -> DataFrame:
    """Every row with its rank: a range sort, then each partition counts on from those before it.

    The sorted rows are written, so that counts and rows come from one run of the sort.
    """
    ordered = written(scored.orderBy(F.desc(by), *tie).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranked")
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.join(F.broadcast(starts), "_p")  # a row per partition
    return placed.withColumn("rank", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_n", "_first", "_before")


def drivers(weights: dict[str, float], k: int = 5) -> Column:
    """The k metrics that add most to a score: [(metric, value, normalized, weight)], order of weights on ties."""
    entries = []
    for n, (m, w) in enumerate(weights.items()):
        norm = F.when(F.col(f"max_{m}") > 0, F.col(m) / F.col(f"max_{m}")).otherwise(0.0)
        fields = F.struct(
            (-F.round(norm, 4) * w).alias("key"), F.lit(n).alias("n"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.round(norm, 4).alias("normalized"), F.lit(w).alias("weight")
        )
        entries.append(F.when(F.col(m) > 0, fields))
    first = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, k)
    return F.transform(first, lambda x: F.struct(x["metric"].alias("metric"), x["value"].alias("value"), x["normalized"].alias("normalized"), x["weight"].alias("weight")))


def evidence(metrics: list[str]) -> Column:
    """Map of the metrics that are not zero."""
    pairs = F.array(*[F.struct(F.lit(m).alias("k"), F.round(F.col(m).cast("double"), 4).alias("v")) for m in metrics])
    return F.map_from_entries(F.filter(pairs, lambda x: F.coalesce(x["v"], F.lit(0.0)) != 0))


def top_metrics(metrics: list[str], k: int = 6) -> Column:
    """The k largest metrics by absolute value, catalogue order on ties: [(name, value)]."""
    every = F.array(*[F.struct((-F.abs(F.col(m).cast("double"))).alias("a"), F.lit(n).alias("n"), F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for n, m in enumerate(metrics)])
    first = F.slice(F.array_sort(F.filter(every, lambda x: F.coalesce(x["value"], F.lit(0.0)) != 0)), 1, k)
    return F.transform(first, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def category(found: Column) -> Column:
    """Category of a finding from its evidence map: a list of decisions, the first that holds."""
    has = lambda *ms: F.exists(F.array(*map(F.lit, ms)), lambda m: F.map_contains_key(found, m))
    get = lambda m: F.coalesce(F.try_element_at(found, F.lit(m)), F.lit(0.0))
    return (
        F.when(has("tsx_render_branching_count", "tsx_nesting_depth", "tsx_prop_count"), "tsx")
        .when(has("ts_any_usage_count", "ts_ignore_count"), "typing")
        .when(has("ts_import_coupling_count"), "coupling")
        .when(has("md_data_url_count"), "docs")
        .when(has("python_import_count"), "python")
        .when(has("todo_count"), "maintainability")
        .when(get("loc") >= get("complexity") * 20, "size")
        .otherwise("complexity")
    )


def priority(s: Column) -> Column:
    return F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low")


PRIORITIES = ["low", "medium", "high"]


def findings(ranked: DataFrame, limit: int = 50, prefix: str = "finding") -> DataFrame:
    """The first row of each (path, category) in rank order, numbered, at most ``limit``."""
    first = Window.partitionBy("path", "category").orderBy("rank")
    kept = ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").orderBy("rank").limit(limit)
    n = F.row_number().over(Window.orderBy("rank"))
    return kept.withColumn("priority", priority(F.col("score"))).withColumn("finding_no", n).withColumn("id", F.concat(F.lit(prefix + "-"), F.lpad(n.cast("string"), 3, "0")))


def gate(found: DataFrame, threshold: str) -> DataFrame:
    """One row: whether any finding reaches the priority threshold, and how many do."""
    at = PRIORITIES.index(threshold)
    return found.agg(F.count_if(F.col("priority").isin(*PRIORITIES[at:])).alias("reached")).select((F.col("reached") > 0).alias("failed"), "reached")


def reason() -> Column:
    """Text of what stands out in a node."""
    parts = F.array(
        F.when(F.col("complexity") != 0, F.concat(F.lit("complexity "), percent_g(F.col("complexity")))),
        F.when(F.col("loc") != 0, F.concat(F.col("loc").cast("string"), F.lit(" LOC"))),
        F.when(F.col("max_nesting_depth") != 0, F.concat(F.lit("nesting depth "), F.col("max_nesting_depth").cast("string"))),
        F.when(F.col("todo_count") != 0, F.concat(F.col("todo_count").cast("string"), F.lit(" TODOs"))),
    )
    said = F.array_compact(parts)
    return F.when(F.size(said) > 0, F.concat(F.lit("High "), F.array_join(said, ", "))).otherwise("Metric hotspot")


def explorer_score(metrics: list[str], inverted: set[str] = frozenset({"comment_density"})) -> Column:
    """Sum of value / maximum over the chosen metrics; inverted ones count 1 - value; nothing below 0."""
    total = F.lit(0.0)
    for m in metrics:
        v = F.greatest(F.lit(0.0), finite(F.col(m).cast("double")))
        total += F.greatest(F.lit(0.0), 1 - v) if m in inverted else F.when(F.col(f"max_{m}") > 0, v / F.col(f"max_{m}")).otherwise(0.0)
    return total
