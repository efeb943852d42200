"""Sources, projections, column statistics, splits and label construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from probewise.functions.numeric import r6, ratio, share, tally
from probewise.functions.ranks import exact_median, exact_quantiles, melt, prefix_counts, spearman
from probewise.functions.student import p_value
from probewise.operators import columns as C
from probewise.plans.scorers import DOC_LOGIT, ORDER_LOGIT, ORDER_STAIRS
from probewise.sources import tables as T


def feature_table(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    return t.select("row_id", *T.ORDER_FEATURES, "label", "is_test")


def doc_feature_table(spark, sf_dir):
    t = T.doc_features(spark, sf_dir)
    return t.select("row_id", *T.DOC_FEATURES, F.col("label").cast("double").alias("label"), "is_test")


def vec_feature_table(spark, sf_dir):
    v = T.vec_features(spark, sf_dir)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    return v.select("row_id", "label", r6(F.element_at("x", 1)).alias("x_first"),
                    r6(norm, 5).alias("norm"))


def binary_filter(spark, sf_dir):
    return T.order_classes(spark, sf_dir).where(F.col("target") != 2)


def row_lookup(spark, sf_dir):
    """The row whose score is closest to 0.5, by key: the one-row form of every operator."""
    t = T.order_features(spark, sf_dir, ORDER_STAIRS.features)
    scored = ORDER_STAIRS.score(t)
    nearest = scored.agg(F.min(F.struct(F.abs(F.col("p") - 0.5), "row_id")).alias("w"))
    key = nearest.select("w.row_id").scalar()
    return scored.where(F.col("row_id") == key).select("row_id", "qty", "gross", r6("p").alias("p"))


def zscore(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    z = C.zscored(t, C.column_stats(t, T.ORDER_FEATURES), T.ORDER_FEATURES)
    return z.select("row_id", *[r6(f"z_{f}").alias(f"z_{f}") for f in T.ORDER_FEATURES])


def zscore_guard(spark, sf_dir):
    t = T.doc_features(spark, sf_dir).withColumn("constant", F.lit(3.5))
    names = ["n_words", "constant"]
    z = C.zscored(t, C.column_stats(t, names), names, guard=True)
    return z.select("row_id", *[r6(f"z_{f}").alias(f"z_{f}") for f in names])


def column_stats(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    long = C.stats_long(C.column_stats(t, T.ORDER_FEATURES), T.ORDER_FEATURES)
    return long.select("feature", *[r6(k, 4).alias(k) for k in ("mean", "std", "min", "max")])


def percentiles(spark, sf_dir):
    long = melt(T.order_features(spark, sf_dir), T.ORDER_FEATURES)
    qs = [0.01, 0.05, 0.5, 0.75, 0.95, 0.99]
    q = exact_quantiles(long, "value", qs, ["feature"])
    names = ["p1", "p5", "p50", "p75", "p95", "p99"]
    return q.select("feature", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(names)])


def group_medians(spark, sf_dir):
    long = melt(T.order_features(spark, sf_dir), T.ORDER_FEATURES, keep=["label"])
    m = exact_median(long, "value", ["label", "feature"])
    return m.select("label", "feature", "n_rows", r6("median").alias("median"))


def reference_rows(spark, sf_dir):
    rows = C.reference_rows(T.doc_features(spark, sf_dir), T.DOC_FEATURES)
    return rows.select("reference", "feature", r6("value").alias("value"))


def corr_pairs(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    pairs = C.pair_moments(t.where(C.train_rows()), T.ORDER_FEATURES)
    return pairs.select("a", "b", r6("r").alias("r"))


def covariance_pairs(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    names = ["qty", "gross", "net"]
    z = C.zscored(t, C.column_stats(t, names), names)
    pairs = C.pair_moments(z, [f"z_{f}" for f in names], "cov")
    return pairs.select("a", "b", r6("r").alias("cov"))


def spearman_pairs(spark, sf_dir):
    t = T.order_features(spark, sf_dir, ["qty", "gross", "avg_disc"])
    pairs = F.array(
        F.struct(F.lit("qty~gross").alias("pair"), F.col("qty").alias("x"),
                 F.col("gross").alias("y")),
        F.struct(F.lit("qty~avg_disc").alias("pair"), F.col("qty").alias("x"),
                 F.col("avg_disc").alias("y")),
    )
    rho = spearman(t.select(F.inline(pairs)), "x", "y", ["pair"])
    return rho.select("pair", r6("rho").alias("rho"), "n", r6("t", 4).alias("t"),
                      r6(p_value(F.col("t"), F.col("n") - 2), 9).alias("p"))


def weighted_var(spark, sf_dir):
    t = T.order_features(spark, sf_dir, ["qty", "gross", "avg_disc"])
    p, w = ORDER_STAIRS.column(), F.col("qty")
    # centred on 0.5 so that the difference of moments keeps its digits
    c = p - 0.5
    one = t.groupBy("label").agg(
        F.sum(w).alias("sw"), F.sum(w * c).alias("s1"), F.sum(w * c * c).alias("s2")
    )
    mean = F.col("s1") / F.col("sw")
    return one.select(
        "label",
        r6(mean + 0.5).alias("weighted_mean"),
        r6(F.col("s2") / F.col("sw") - mean * mean).alias("weighted_var"),
    )


def confidence_bands(spark, sf_dir):
    t = ORDER_STAIRS.score(T.order_features(spark, sf_dir, ORDER_STAIRS.features))
    b = t.withColumn("band", C.confidence_band(F.col("p"))).where(F.col("band").isNotNull())
    hit = (F.col("p") >= 0.5).cast("int") == F.col("label")
    return b.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"), r6(share(hit)).alias("accuracy")
    )


def half_open_bands(spark, sf_dir):
    t = ORDER_LOGIT.score(T.order_features(spark, sf_dir, ORDER_LOGIT.features))
    b = t.withColumn("band", C.half_open_band(F.col("p")))
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"))


def ratio_floor(spark, sf_dir):
    docs = T.doc_features(spark, sf_dir).select(
        F.lit("n_chars/n_words").alias("pair"),
        ratio(F.col("n_chars"), F.col("n_words")).alias("ratio"),
        F.lit(6.0).alias("floor"),
    )
    orders = T.order_features(spark, sf_dir, ["net", "gross"]).select(
        F.lit("net/gross").alias("pair"),
        ratio(F.col("net"), F.col("gross")).alias("ratio"),
        F.lit(0.93).alias("floor"),
    )
    return docs.unionByName(orders).groupBy("pair").agg(
        r6(F.min("ratio")).alias("min_ratio"),
        tally(F.col("ratio") < F.col("floor")).alias("below"),
        F.count("ratio").alias("n"),
    )


def stratified_split(spark, sf_dir):
    t = T.order_features(spark, sf_dir, ["qty"])
    return C.stratified_split(t).select("row_id", "label", "is_test")


def kfold_assign(spark, sf_dir):
    t = T.order_features(spark, sf_dir, ["qty"])
    return C.kfold(t).select("row_id", "label", "fold")


def interaction_label(spark, sf_dir):
    t = T.order_features(spark, sf_dir, ["qty", "gross"])
    stats = C.column_stats(t, ["qty", "gross"])
    strengths = F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 0.75, 1.0)])
    wide = t.withColumn("strength", F.explode(strengths))
    labelled = C.interaction_label(wide, stats, "qty", "gross", F.col("strength"))
    return labelled.groupBy("strength").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives")
    )


def metrics(spark, sf_dir):
    """Accuracy at the inclusive 0.5 cut and ROC-AUC by ranks, ties exact."""
    t = ORDER_STAIRS.score(T.order_features(spark, sf_dir, ORDER_STAIRS.features))
    return auc_and_accuracy(t)


def auc_and_accuracy(scored):
    label = F.col("label").cast("long")
    cells = prefix_counts(
        scored.where(F.col("p").isNotNull()), "p", measures={"pos": label, "neg": 1 - label}
    )
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    auc = wins / (F.max("pos_total") * F.max("neg_total"))
    right = F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    return cells.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        r6(F.sum(right) / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"),
        r6(auc).alias("auc"),
    )


def accuracy_by_band(spark, sf_dir):
    t = DOC_LOGIT.score(T.doc_features(spark, sf_dir).where("label IS NOT NULL"))
    b = t.withColumn("band", C.half_open_band(F.col("p")))
    hit = (F.col("p") >= 0.5).cast("int") == F.col("label")
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), r6(share(hit)).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_table, doc_feature_table, vec_feature_table, binary_filter, row_lookup, zscore,
        zscore_guard, column_stats, percentiles, group_medians, reference_rows, corr_pairs,
        covariance_pairs, spearman_pairs, weighted_var, confidence_bands, half_open_bands,
        ratio_floor, stratified_split, kfold_assign, interaction_label, metrics, accuracy_by_band,
    )
}
