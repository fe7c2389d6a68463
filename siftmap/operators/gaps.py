"""Where is evidence thin: coverage against an expected share, and inequality between regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADAPTATION = ["adaptation", "maladaptation"]


def expected_shares(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "region string, expected_share double")


def _relevant(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.filter(F.col("p_relevant") >= threshold).select("doc_id")


def _coverage(per_region: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds the shares. Documents are counted per region before the join with the fixed list, so
    the join moves one row per region; regions without documents stay, and documents without a
    listed region count in the total only."""
    total = per_region.agg(F.coalesce(F.sum("n_all"), F.lit(0))).scalar()
    observed = F.try_divide(F.col("n_docs"), total)
    return (
        expected.join(per_region.filter(F.col("region").isNotNull()), "region", "left")
        .withColumn("n_docs", F.coalesce("n_all", F.lit(0)).cast("bigint"))
        .withColumn("observed_share", observed)
        .withColumn("coverage_ratio", F.try_divide("observed_share", "expected_share"))
        .withColumn("grey_share", F.try_divide("n_grey", "n_docs"))
        .withColumn("non_english_share", F.try_divide("n_other", "n_docs"))
    )


def _counts():
    return [
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("source_type") != "peer_reviewed").alias("n_grey"),
        F.count_if(F.col("language") != "en").alias("n_other"),
    ]


SHARES = ["region", "n_docs", "observed_share", "expected_share", "coverage_ratio", "grey_share", "non_english_share"]


def by_region(corpus: DataFrame, scores: DataFrame, metadata: DataFrame, expected: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Coverage per region. The outcome share divides all documents with an outcome by adaptation documents."""
    docs = (
        corpus.select("doc_id", "region", "source_type", "language", "evidence_type", "outcome_reported")
        .join(_relevant(scores, threshold), "doc_id")
        .join(metadata.select("doc_id", F.col("region").alias("_region")), "doc_id", "left")
    )
    per_region = docs.groupBy(F.coalesce("region", "_region").alias("region")).agg(
        *_counts(),
        F.count_if(F.col("evidence_type").isin(ADAPTATION)).alias("n_adapt"),
        F.count_if("outcome_reported").alias("n_outcome"),
    )
    return _coverage(per_region, expected).select(
        *SHARES,
        F.try_divide("n_adapt", "n_docs").alias("adaptation_share"),
        F.try_divide("n_outcome", "n_adapt").alias("adaptation_with_outcome_share"),
    )


def by_region_plain(predictions: DataFrame, expected: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same from scored documents alone; adaptation columns are not known yet."""
    per_region = predictions.filter(F.col("p_relevant") >= threshold).groupBy("region").agg(*_counts())
    unknown = F.lit(None).cast("double")
    return _coverage(per_region, expected).select(
        *SHARES, unknown.alias("adaptation_share"), unknown.alias("adaptation_with_outcome_share")
    )


def region_sector(corpus: DataFrame, scores: DataFrame, metadata: DataFrame, threshold: float = 0.5) -> DataFrame:
    docs = (
        corpus.select("doc_id", "region", "sector", "evidence_type", "outcome_reported")
        .join(_relevant(scores, threshold), "doc_id")
        .join(metadata.select("doc_id", F.col("region").alias("_region"), F.col("sector").alias("_sector")), "doc_id", "left")
    )
    return docs.groupBy(
        F.coalesce("region", "_region", F.lit("Unknown")).alias("region"),
        F.coalesce("sector", "_sector", F.lit("Unknown")).alias("sector"),
    ).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("evidence_type") == "adaptation").alias("n_adaptation"),
        F.count_if(F.col("evidence_type") == "maladaptation").alias("n_maladaptation"),
        F.count_if("outcome_reported").alias("n_with_outcome"),
    )


def region_sector_plain(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return predictions.filter(F.col("p_relevant") >= threshold).groupBy("region").agg(F.count(F.lit(1)).alias("n_docs")).select(
        "region", F.lit("Not enriched").alias("sector"), "n_docs",
        zero.alias("n_adaptation"), zero.alias("n_maladaptation"), zero.alias("n_with_outcome"),
    )


def ranked_counts(regions: DataFrame, value: str = "n_docs") -> DataFrame:
    """Each region's place in the order of counts, with the number of regions and their total. The input is one row per region."""
    ascending = Window.orderBy(value, "region")
    whole = ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return regions.select(
        "region", F.col(value).alias("docs"), F.row_number().over(ascending).cast("bigint").alias("position"),
        F.count(F.lit(1)).over(whole).alias("regions"), F.sum(value).over(whole).cast("bigint").alias("total"),
    )


def gini(regions: DataFrame, value: str = "n_docs") -> DataFrame:
    """0 = even, 1 = everything in one region; NULL when nothing is counted.

    Half the mean difference over the mean; in order of size every count enters as often as it is the larger of a pair, less
    the times it is the smaller.
    """
    larger_less_smaller = F.col("position") - 1 - (F.col("regions") - F.col("position"))
    spread = F.sum((larger_less_smaller * F.col("docs")).cast("double"))
    most = F.max((F.col("regions") * F.col("total")).cast("double"))
    return ranked_counts(regions, value).agg(F.round(F.try_divide(spread, most), 4).alias("gini_region"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Studies per context and adaptation type; a single study has no deviation."""
    return outcomes.groupBy("context_similarity_key", "adaptation_type").agg(
        F.count(F.lit(1)).alias("n_studies"),
        *[F.count_if(F.col("outcome_direction") == k).alias(f"n_{k}") for k in ("positive", "negative", "mixed")],
        F.avg("effect_size").alias("mean_effect"),
        F.stddev_samp("effect_size").alias("sd_effect"),
    )


def under_covered(regions: DataFrame, threshold: float = 0.6) -> DataFrame:
    return regions.filter(F.coalesce("coverage_ratio", F.lit(1.0)) < threshold)


def share_report(corpus: DataFrame) -> DataFrame:
    """Share of documents per region (off-topic left out) and per language."""
    region = corpus.filter(F.col("evidence_type") != "off_topic").groupBy(F.lit("region").alias("kind"), F.col("region").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    language = corpus.groupBy(F.lit("language").alias("kind"), F.col("language").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind")
    return region.unionByName(language).withColumn("share", F.col("n") / F.sum("n").over(w))


def merge_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows unchanged, plus source rows whose key the target lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"))
