"""Clusters of relevant documents and the cluster x region evidence map."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmap.functions.vectors import as_double

MAP_KEYS = ["cluster_id", "label", "sector", "evidence_focus", "region"]


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per cluster. Map tasks send one partial sum per cluster, whatever its size."""
    v = vectors.select("cluster_id", array_to_vector(as_double("embedding")).alias("v"))
    return v.groupBy("cluster_id").agg(Summarizer.mean(F.col("v")).alias("m")).select(
        "cluster_id", vector_to_array("m").alias("centroid")
    )


def top_values(df: DataFrame, keys: list[str], value: str, k: int = 3) -> DataFrame:
    """Exact k most frequent values per group, NULL counted as a value; ties by value.

    Rows are counted before the ranking, and the rank limit prunes each task's counts.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return _top_of_counts(counts, keys, value, k)


def _top_of_counts(counts: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    listed = F.sort_array(F.collect_list(F.struct("rn", F.col(value).alias("value"), F.col("n").alias("count"))))
    return top.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(f"top_{value}"))


def evidence_map(clusters: DataFrame, corpus: DataFrame, labels: DataFrame, metadata: DataFrame, k: int = 3) -> DataFrame:
    """One row per cluster and region with counts, shares, years and the k most frequent hazards.

    A first aggregation by (keys, hazard) feeds both the totals and the top list, so documents
    are shuffled once and a hot cell is already combined by then.
    """
    docs = (
        clusters.select("doc_id", "cluster_id")
        .join(corpus.select("doc_id", "region", "source_type", "outcome_reported", "year", "hazard"), "doc_id")
        .join(metadata.select("doc_id", F.col("region").alias("_region"), F.col("outcome_reported").alias("_outcome")), "doc_id", "left")
        .select(
            "cluster_id",
            F.coalesce("region", "_region", F.lit("Unknown")).alias("region"),
            (F.col("source_type") != "peer_reviewed").alias("grey"),
            F.coalesce("outcome_reported", "_outcome").alias("outcome"),
            "year", "hazard",
        )
    )
    cells = docs.groupBy("cluster_id", "region", "hazard").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("grey").alias("grey"), F.count_if("outcome").alias("outcome"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    keys = ["cluster_id", "region"]
    totals = cells.groupBy(*keys).agg(
        F.sum("n").alias("n_docs"),
        F.try_divide(F.sum("grey"), F.sum("n")).alias("grey_share"),
        F.try_divide(F.sum("outcome"), F.sum("n")).alias("outcome_share"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
    )
    tops = _top_of_counts(cells.select(*keys, "hazard", "n"), keys, "hazard", k)
    names = labels.select("cluster_id", "label", "sector", "evidence_focus")
    return totals.join(tops, keys).join(names, "cluster_id", "left").select(
        *MAP_KEYS, "n_docs", "grey_share", "outcome_share", "first_year", "last_year", F.col("top_hazard").alias("top_hazards")
    )


def evidence_map_plain(clusters: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The map before enrichment: only labelled clusters, one placeholder hazard."""
    return (
        clusters.select("doc_id", "cluster_id")
        .join(corpus.select("doc_id", "region", "source_type", "outcome_reported", "year"), "doc_id")
        .groupBy("cluster_id", F.coalesce("region", F.lit("Unknown")).alias("region"))
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.try_divide(F.count_if(F.col("source_type") != "peer_reviewed"), F.count(F.lit(1))).alias("grey_share"),
            F.try_divide(F.count_if("outcome_reported"), F.count(F.lit(1))).alias("outcome_share"),
            F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        )
        .join(labels.select("cluster_id", "label", "sector", "evidence_focus"), "cluster_id")
        .select(
            *MAP_KEYS, "n_docs", "grey_share", "outcome_share", "first_year", "last_year",
            F.array(F.struct(F.lit("Not enriched").alias("value"), F.col("n_docs").alias("count"))).alias("top_hazards"),
        )
    )


def top_titles(doc_clusters: DataFrame, corpus: DataFrame, k: int = 12) -> DataFrame:
    """The k most central titles of each cluster, one per line, and the cluster size.

    Titles join after the cut, so text moves only for k documents per cluster.
    """
    w = Window.partitionBy("cluster_id").orderBy("dist_to_centroid", "doc_id")
    in_corpus = doc_clusters.join(corpus.select("doc_id"), "doc_id", "left_semi")
    top = in_corpus.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    lines = (
        top.join(corpus.select("doc_id", "title"), "doc_id")
        .groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rn", "title"))).alias("t"))
        .select("cluster_id", F.array_join(F.transform("t", lambda x: x["title"]), "\n").alias("titles"))
    )
    sizes = in_corpus.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return sizes.join(lines, "cluster_id")


def pivot(cells: DataFrame, regions: list[str]) -> DataFrame:
    """Cluster x region counts with colour intensity log1p(n) / log1p(max n).

    `regions` come first, further ones in the data follow by name: none is left out.
    """
    found = [r[0] for r in cells.filter(F.col("region").isNotNull()).select("region").distinct().collect()]  # a handful of names
    regions = [*regions, *sorted(set(found) - set(regions))]
    per = cells.groupBy("cluster_id", "region").agg(F.sum("n_docs").alias("n"))
    top = per.agg(F.greatest(F.lit(1), F.max("n")).alias("m")).scalar()
    shaded = per.withColumn("shade", F.log1p("n") / F.log1p(top))
    return shaded.groupBy("cluster_id").pivot("region", regions).agg(F.sum("n").alias("n"), F.max("shade").alias("shade"))


def cluster_documents(doc_clusters: DataFrame, corpus: DataFrame, cluster_id: int, limit: int = 30) -> DataFrame:
    """Documents of one cluster, nearest first."""
    near = (
        doc_clusters.filter(F.col("cluster_id") == cluster_id).join(corpus.select("doc_id"), "doc_id", "left_semi")
        .orderBy("dist_to_centroid", "doc_id").limit(limit)
    )
    return near.join(corpus.select("doc_id", "title", "year", "region", "source_type", "evidence_type"), "doc_id").select(
        "doc_id", "title", "year", "region", "source_type", "evidence_type", F.round("dist_to_centroid", 4).alias("dist_to_centroid")
    ).orderBy("dist_to_centroid", "doc_id")


def coherence(labels: DataFrame, decisions: DataFrame, dbi: DataFrame | None = None) -> DataFrame:
    """Votes per cluster; clusters without votes stay with zeros. `dbi` is one row with the newest index."""
    votes = (
        decisions.filter(F.col("decision_type").isin("cluster_coherent", "cluster_incoherent"))
        .groupBy("cluster_id")
        .agg(
            F.count_if(F.col("decision_type") == "cluster_coherent").alias("votes_coherent"),
            F.count_if(F.col("decision_type") == "cluster_incoherent").alias("votes_incoherent"),
        )
    )
    out = labels.select("cluster_id", "label", "coherence_guess").join(votes, "cluster_id", "left").fillna(0, ["votes_coherent", "votes_incoherent"])
    if dbi is not None:
        out = out.withColumn("davies_bouldin", dbi.select("davies_bouldin_index").scalar())
    return out
