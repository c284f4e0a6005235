"""Recency, frequency and monetary value of customers, and their segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.calendar import elapsed_days
from granary.functions.numeric import exact_sum, standardised
from granary.operators import segmenting

METRICS = ("recency", "frequency", "monetary")
#: Labels from the least to the greatest mean monetary value.
LABELS = ("Hibernating / At-Risk", "About to Sleep", "Leal Customers", "Champions")
#: Next action by label, and the one for any other label.
ACTIONS = {
    "Champions": "Offer early access to new product rollouts. Reward with exclusive loyalty incentives.",
    "Leal Customers": "Upsell premium bundles or subscription tiers. Solicit reviews or referrals.",
    "About to Sleep": "Send limited-time personalized discount hooks to incentivize re-engagement.",
    "Hibernating / At-Risk": "Launch an aggressive win-back campaign via email offering steep value matches.",
}
OTHER_ACTION = "Maintain standard outreach pipelines."


def profiles(events: DataFrame, customer: str, order: str, time: str, amount: Column) -> DataFrame:
    """customer_id, recency, frequency, monetary of each customer.

    Recency is in whole days before one day after the last event of all; frequency
    counts different orders; rows without a customer only count for the last event.

    One pass: the last event of all is taken from those of the customers. For that
    both sides read the same aggregate and reuse its exchange, so the maximum is of
    structs with all its columns, and customers are told from their absence by a
    maximum, not by the key, on which a filter would be pushed below one side only.
    """
    by = events.groupBy(F.col(customer).alias("customer_id")).agg(F.max(time).alias("last"), F.countDistinct(order).alias("frequency"), exact_sum(amount).alias("monetary"), F.max(customer).alias("who"))
    end = by.agg((F.max(F.struct("last", "frequency", "monetary", "who"))["last"] + F.expr("interval 1 day")).alias("end")).scalar()
    return by.where(F.col("who").isNotNull()).select("customer_id", elapsed_days(F.col("last"), end).alias("recency"), "frequency", "monetary")


def rfm(transactions: DataFrame) -> DataFrame:
    return profiles(transactions, "customer_id", "invoice_no", "invoice_date", F.col("quantity") * F.col("unit_price"))


def scaled(rfm_: DataFrame) -> DataFrame:
    """Adds z_recency, z_frequency, z_monetary: log(1 + x), less its mean, over its population deviation."""
    logs = {m: F.log1p(m) for m in METRICS}
    stats = rfm_.agg(F.struct(*(F.avg(logs[m]).alias(f"m_{m}") for m in METRICS), *(F.stddev_pop(logs[m]).alias(f"d_{m}") for m in METRICS)).alias("s")).scalar()
    return rfm_.select("*", *(standardised(logs[m], stats.getField(f"m_{m}"), stats.getField(f"d_{m}")).alias(f"z_{m}") for m in METRICS))


def nearest(points: DataFrame, centers: list[tuple[float, ...]], places: int = 6) -> DataFrame:
    """Adds ``cluster``: the nearest of given centers in scaled space, the first of equals."""
    def far(center: tuple[float, ...]) -> Column:
        return reduce(lambda s, x: s + x, (F.pow(F.round(f"z_{m}", places) - float(c), F.lit(2.0)) for m, c in zip(METRICS, center, strict=True)))

    ranked = F.array(*(F.struct(F.round(far(c), places).alias("far"), F.lit(i).alias("i")) for i, c in enumerate(centers)))
    return points.withColumn("cluster", F.array_min(ranked)["i"])


def lloyd(points: DataFrame, centers: list[tuple[float, ...]], steps: int = 5, places: int = 6) -> tuple[list[tuple[float, ...]], DataFrame]:
    """K-Means from given centers: after so many steps the centers, and the points with their ``cluster``.

    A step assigns all points and takes each cluster's mean; only the centers, one row
    each, come to the driver. A cluster without points keeps its center.
    """
    for _ in range(steps):
        means = nearest(points, centers, places).groupBy("cluster").agg(*(F.round(F.avg(F.round(f"z_{m}", places)), places).alias(m) for m in METRICS)).collect()
        found = {r.cluster: tuple(r[m] for m in METRICS) for r in means}
        centers = [found.get(i, c) for i, c in enumerate(centers)]
    return centers, nearest(points, centers, places)


def cost(clustered: DataFrame, centers: list[tuple[float, ...]], places: int = 6) -> DataFrame:
    """(cluster, customer_count, cost): squared distances to the clusters' centers in scaled space."""
    def far(center: tuple[float, ...]) -> Column:
        return reduce(lambda s, x: s + x, (F.pow(F.round(f"z_{m}", places) - float(c), F.lit(2.0)) for m, c in zip(METRICS, center, strict=True)))

    own = reduce(lambda rest, x: F.when(F.col("cluster") == x[0], far(x[1])).otherwise(rest), enumerate(centers), F.lit(None).cast("double"))
    return clustered.groupBy("cluster").agg(F.count("*").alias("customer_count"), exact_sum(own, 10).alias("cost"))


def k_means(points: DataFrame, k: int = 4, starts: int = 10, seed: int = 42, steps: int = 300) -> tuple[DataFrame, float]:
    """Adds ``cluster`` by the best of several K-Means runs on the scaled metrics, from k-means++ starts; also its cost."""
    return segmenting.k_means(points, [f"z_{m}" for m in METRICS], "customer_id", k, starts, seed, steps)


def cluster_labels(clustered: DataFrame) -> DataFrame:
    """(cluster, mean_monetary, segment_label), labels in ascending order of mean monetary value.

    There are as many rows as clusters, so the window over all of them is small.
    """
    means = clustered.groupBy("cluster").agg(F.avg("monetary").alias("mean_monetary"))
    order = F.row_number().over(Window.orderBy("mean_monetary", "cluster"))
    return means.select("cluster", "mean_monetary", F.try_element_at(F.array(*map(F.lit, LABELS)), order).alias("segment_label"))


def labelled(clustered: DataFrame, check: bool = False) -> DataFrame:
    """Adds ``segment_label``. ``check`` raises unless there is a cluster for each label."""
    labels = cluster_labels(clustered).select("cluster", "segment_label")
    if check and (n := labels.count()) != len(LABELS):
        raise ValueError(f"{len(LABELS)} clusters are needed for the labels, there are {n}")
    return clustered.join(F.broadcast(labels), "cluster", "left").select("customer_id", *METRICS, "cluster", "segment_label")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Mean metrics and number of customers of each label."""
    return segments.groupBy("segment_label").agg(*(F.avg(m).alias(m) for m in METRICS), F.count("customer_id").alias("customer_count"))


def next_action(label: Column) -> Column:
    pairs = [F.lit(x) for item in ACTIONS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(label, F.lit(""))), F.lit(OTHER_ACTION))


def k_means_segments(transactions: DataFrame, starts: int = 10) -> DataFrame:
    """customer_segments: profiles, scaled, clustered and labelled."""
    return labelled(k_means(scaled(rfm(transactions)), starts=starts)[0])


def silhouette(clustered: DataFrame) -> float:
    """Extra: mean silhouette of ``cluster`` in scaled space (squared Euclidean)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=[f"z_{m}" for m in METRICS], outputCol="features").transform(clustered)
    return ClusteringEvaluator(predictionCol="cluster").evaluate(vectors)
