"""Queries with fitted models. A fit depends on the engine's own randomness, so DuckDB has no twin of it;
``oracles.models`` gives SQL over the fitted nodes instead, which the tests run against these queries."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.functions.materialise import materialise
from probewise.functions.numeric import r6, share
from probewise.functions.ranks import exact_median, spearman
from probewise.functions.student import p_value
from probewise.operators import cloud as CL
from probewise.operators import columns as C
from probewise.operators import models as M
from probewise.operators import profiles as P
from probewise.operators import slices as SL
from probewise.operators import surrogate as S
from probewise.plans.basics import auc_and_accuracy
from probewise.plans.scorers import MLScorer
from probewise.plans.surrogate import confidence_span
from probewise.sources import tables as T

DOCS = T.DOC_FEATURES


def _labelled(spark, sf_dir) -> DataFrame:
    return T.doc_features(spark, sf_dir).where("label IS NOT NULL")


def _docs(spark, sf_dir) -> DataFrame:
    """All documents, split, written once: fitting reads it many times. Those without a label are a
    class of their own in the split and are probed like the others."""
    return materialise(C.stratified_split(T.doc_features(spark, sf_dir)))


def _train(t: DataFrame) -> DataFrame:
    return t.where(C.train_rows()).where("label IS NOT NULL")


def _fit(t: DataFrame, make, features=DOCS) -> MLScorer:
    train = _train(t)
    return MLScorer(make(train).fit(train), features)


def _test_scores(t: DataFrame, scorer) -> DataFrame:
    return scorer.score(t.where("is_test")).select("row_id", "label", r6("p").alias("p"))


def rf_scores(spark, sf_dir):
    t = _docs(spark, sf_dir)
    return _test_scores(t, M.tree_scorer(_train(t), DOCS))


def gbt_scores(spark, sf_dir):
    t = _docs(spark, sf_dir)
    return _test_scores(t, M.boosted_scorer(_train(t), DOCS))


def logreg_scores(spark, sf_dir):
    t = _docs(spark, sf_dir)
    return _test_scores(t, _fit(t, lambda train: M.logistic(DOCS, train.count())))


def rf_metrics(spark, sf_dir):
    return auc_and_accuracy(materialise(rf_scores(spark, sf_dir).where("label IS NOT NULL")))


def importance_topk(spark, sf_dir):
    t = _docs(spark, sf_dir)
    nodes = M.fit_forests([_train(t)], DOCS, [42])[0]
    return M.importances(nodes, DOCS, spark).where(F.col("rank") <= 2)


def oof_scores(spark, sf_dir):
    t = materialise(C.kfold(_labelled(spark, sf_dir)))
    return M.out_of_fold(t, DOCS).select("row_id", "fold", "label", r6("p").alias("p"))


def oof_accuracy_by_band(spark, sf_dir):
    scored = materialise(oof_scores(spark, sf_dir))
    hit = (F.col("p") >= 0.5).cast("int") == F.col("label")
    banded = scored.withColumn("band", C.half_open_band(F.col("p")))
    return C.attach(
        banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), r6(share(hit)).alias("accuracy")),
        auc_and_accuracy(scored), "all",
    ).select("band", "n", "accuracy", F.col("all.auc").alias("auc"))


def _curves(sweeps: DataFrame, scorer, n: int, keep: list[str], swept: list[str], model: str | None = None) -> DataFrame:
    """(keep, lo, hi, _p): the scorer's curves along sweeps of ``swept``, an array a sweep."""
    z = F.expr(f"transform(sequence(0, {n - 1}), i -> {P.point_sql('i', n)})")
    return scorer.curves(sweeps.withColumn("_z", z), "feature", "_z", "_p", swept, model).select(*keep, "lo", "hi", "_p")


def _curve_points(curves: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(keep, model, grid_idx, z, p, slope) of curves. Slopes are central
    inside and one-sided at the ends, taken between neighbours of the same array."""
    curves = curves.withColumn("_z", F.expr(f"transform(sequence(0, {n - 1}), i -> {P.point_sql('i', n)})"))
    models = F.sequence(F.lit(0), (F.size("_p") / n).cast("int") - 1)
    curves = curves.select(*keep, "_z", "_p", F.explode(models).alias("model"))
    p = lambda i: F.get("_p", F.col("model") * n + i)
    i, z = F.col("grid_idx"), lambda i: F.get("_z", i)
    points = curves.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("grid_idx"))
    left, right = F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.lit(n - 1))
    slope = (p(right) - p(left)) / (z(right) - z(left))
    return points.select(*keep, "model", "grid_idx", z(i).alias("z"), p(i).alias("p"), slope.alias("slope"))


def ice_forest(spark, sf_dir):
    """Partial dependence and disagreement of the forest."""
    t = _docs(spark, sf_dir)
    scorer, stats = M.tree_scorer(_train(t), DOCS), C.column_stats(t, DOCS)
    sweeps = P.sweep_rows(t.where("is_test"), stats, ["n_words", "n_chars"])
    keep = ["row_id", "feature"]
    b = P.bundle_summary(_curve_points(_curves(sweeps, scorer, 120, keep, ["n_words", "n_chars"]), 120, keep))
    return b.select("feature", "grid_idx", r6("pdp").alias("pdp"), "moving", "against",
                    r6("against_share").alias("against_share"))


def cp_seed_forest(spark, sf_dir):
    """Twelve refits over one grid: how much of a profile, and of its largest step's place, is the seed."""
    t = _docs(spark, sf_dir)
    stats = C.column_stats(t, DOCS)
    scorer = M.tree_scorer(_train(t), DOCS, list(range(M.SEEDS)))
    sweeps = P.sweep_rows(t.where("is_test"), stats, ["n_chars"], span=2.5)
    z = F.expr(f"transform(sequence(0, 199), i -> {P.point_sql('i', 200)})")
    found = scorer.seed_spread(sweeps.withColumn("_z", z), "_z", "n_chars", "w")
    return found.select("row_id", *[r6(F.col(f"w.{c}"), 3 if "step" in c else 6).alias(c) for c in (
        "swing_median", "swing_min", "swing_max", "step_median", "step_min", "step_max", "sd_median", "sd_max")])


def boundary_seeds(spark, sf_dir, nx=220, ny=200):
    """Distance to the boundary under twelve refits on the full window, from the leaves' boxes in it."""
    t = _docs(spark, sf_dir)
    stats = C.column_stats(t, DOCS)
    scorer = M.tree_scorer(_train(t), DOCS, list(range(M.SEEDS)))
    w = SL.windowed(t.where("is_test"), stats, "n_words", "n_chars")
    grid = lambda n, axis: F.expr(
        f"transform(sequence(0, {n - 1}), i -> {P.point_sql('i', n, f'lo_{axis}', f'hi_{axis}')})")
    w = w.select("row_id", *DOCS, "std_x", "std_y", grid(nx, "x").alias("zx"), grid(ny, "y").alias("zy"))
    w = scorer.boundary_distances(w, "n_words", "n_chars", "zx", "zy", "std_x", "std_y", "d")
    w = w.select("row_id", F.array_sort(F.filter("d", lambda v: v.isNotNull())).alias("d"))
    n = F.size("d")
    # twelve values at most: the two in the middle, or the same one twice
    low, high = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    return w.select("row_id", n.cast("long").alias("n"), r6(F.array_min("d")).alias("min"),
                    r6((F.get("d", low) + F.get("d", high)) / 2).alias("median"), r6(F.array_max("d")).alias("max"))


STRENGTHS = [0.0, 0.25, 0.5, 0.75, 1.0]


def interaction_tables(spark, sf_dir):
    """The documents labelled and split at each strength, the forests fitted to them, and the stats."""
    t = T.doc_features(spark, sf_dir)
    stats = C.column_stats(t, ["n_words", "chars_per_word", "n_chars"])
    tables = [
        materialise(C.stratified_split(C.interaction_label(t, stats, "n_words", "chars_per_word", F.lit(a))))
        for a in STRENGTHS
    ]
    return tables, M.forests([d.where(C.train_rows()) for d in tables], DOCS, [42] * len(tables)), stats


def interaction_forest(spark, sf_dir):
    """Forests fitted to labels with the interaction dialled from 0 to 1, through the same probe."""
    tables, trees, stats = interaction_tables(spark, sf_dir)
    held_out = reduce(DataFrame.unionByName, [
        d.where("is_test").withColumns({"strength": F.lit(a), "nr": F.lit(k)}) for k, (a, d) in enumerate(zip(STRENGTHS, tables))])
    sweeps = P.sweep_rows(held_out, stats, ["n_words"])
    # a row a sweep is kept; its points are made where they are summed up
    curves = materialise(_curves(sweeps, M.scorer_of(spark, trees, DOCS), 120, ["row_id", "strength"], ["n_words"], "nr"))
    curves = _curve_points(curves, 120, ["row_id", "strength"])
    b = P.bundle_summary(curves, ["strength"])
    ranges = curves.groupBy("row_id", "strength").agg((F.max("p") - F.min("p")).alias("range"))
    swing = b.groupBy("strength").agg((F.max("pdp") - F.min("pdp")).alias("pdp_swing"))
    table = swing.join(exact_median(ranges, "range", ["strength"]), "strength").join(
        P.steepest(b, ["strength"]), "strength")
    return table.select("strength", r6("against_at_steepest").alias("against_at_steepest"),
                        r6("pdp_swing").alias("pdp_swing"), r6("median").alias("median"),
                        r6(F.col("pdp_swing") / F.nullif(F.col("median"), F.lit(0.0))).alias("ratio"))


def explain_forest(spark, sf_dir):
    t = _docs(spark, sf_dir)
    stats, scorer = C.column_stats(t, DOCS), M.tree_scorer(_train(t), DOCS)
    rows = scorer.score(C.zscored(t.where("is_test"), stats, DOCS))
    draws = scorer.score(CL.cloud(spark, stats, DOCS))
    e = S.explain(rows, CL.share_cloud(draws, DOCS, CL.DRAWS, (42,)), 2)
    return e.select("row_id", *[r6(F.col("coef")[i]).alias(f"coef_{f}") for i, f in enumerate(DOCS)],
                    r6("p").alias("p"), r6("g").alias("g"), r6("r2").alias("r2"))


def _settings(spark, sf_dir, names) -> list[tuple]:
    """(name, split table, features, fitted scorer) of each setting, fitted side by side."""
    docs, vec = T.doc_features(spark, sf_dir), T.vec_features(spark, sf_dir)
    vectors, dims = T.vec_columns(vec, 64)
    orders = T.order_features(spark, sf_dir)
    logistic = lambda f: lambda train: MLScorer(M.logistic(f, train.count()).fit(train), f)
    known = {
        "docs_forest": (docs, DOCS, lambda train: M.tree_scorer(train, DOCS)),
        "docs_boosted": (docs, DOCS, lambda train: M.boosted_scorer(train, DOCS)),
        "docs_logistic": (docs, DOCS, logistic(DOCS)),
        "vectors_forest": (vectors, dims, lambda train: M.tree_scorer(train, dims)),
        "vectors_logistic": (vectors, dims, logistic(dims)),
        "orders_logistic": (orders, T.ORDER_FEATURES, logistic(T.ORDER_FEATURES)),
    }
    split: dict[int, DataFrame] = {}
    picked = []
    for n in names:
        table, features, estimator = known[n]
        if id(table) not in split:
            split[id(table)] = materialise(C.stratified_split(table))
        picked.append((n, split[id(table)], features, estimator))
    trains = [_train(t) for _, t, _, _ in picked]
    with ThreadPool(len(picked)) as pool:
        scorers = pool.starmap(lambda train, p: p[3](train), zip(trains, picked, strict=True))
    return [(n, t, f, s) for (n, t, f, _), s in zip(picked, scorers, strict=True)]


def _spanning_rows(t, features, scorer, points):
    """Rows at equal steps of confidence among the held-out ones, standardised and scored."""
    stats = C.column_stats(t, features)
    rows = materialise(scorer.score(C.zscored(t.where("is_test"), stats, features, guard=True)))
    # at most ``points`` keys, a parameter of the protocol
    return stats, rows.join(F.broadcast(confidence_span(rows, points).select("row_id", "conf")), "row_id")


def replication(spark, sf_dir):
    """Fidelity against confidence under one protocol in five settings, two of them forests."""
    parts = []
    for name, t, features, scorer in _settings(
        spark, sf_dir, ["docs_forest", "docs_boosted", "docs_logistic", "vectors_forest", "vectors_logistic"]
    ):
        stats, rows = _spanning_rows(t, features, scorer, 55)
        draws = scorer.score(CL.cloud(spark, stats, features, 2000))
        e = S.explain(rows, CL.share_cloud(draws, features, 2000, (42,)), min(8, len(features)), keep=["conf"])
        parts.append(e.select(F.lit(name).alias("setting"), "conf", F.round("r2", 9).alias("r2")))
    rho = spearman(materialise(reduce(DataFrame.unionByName, parts)), "conf", "r2", ["setting"])
    return rho.select("setting", r6("rho").alias("rho"), "n", r6("t", 4).alias("t"),
                      r6(p_value(F.col("t"), F.col("n") - 2), 9).alias("p"))


def kernel_inertness(spark, sf_dir):
    """How far deleting the kernel moves an explanation, over settings of 3, 7 and 64 columns."""
    parts = []
    for name, t, features, scorer in _settings(
        spark, sf_dir,
        ["docs_forest", "docs_boosted", "docs_logistic", "orders_logistic", "vectors_forest", "vectors_logistic"],
    ):
        p = len(features)
        k = max(2, min(8, p // 2))
        stats, rows = _spanning_rows(t, features, scorer, 5)
        draws = scorer.score(CL.cloud(spark, stats, features, 2000))
        e = S.explain(rows, CL.share_cloud(draws, features, 2000, (42,)), k,
                      variants=("kernel", "uniform"), include_self=False)
        pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
        one = e.groupBy("row_id").agg(
            F.abs(pick("kernel", "g") - pick("uniform", "g")).alias("dg"),
            (F.size(F.array_intersect(pick("kernel", "kept"), pick("uniform", "kept"))) / k).alias("kept"))
        # five rows per setting by protocol
        parts.append(one.agg(
            F.lit(name).alias("setting"), F.lit(p).alias("columns"), r6(F.lit(float(S.kernel_width(p)))).alias("width"),
            r6(F.percentile("dg", F.lit(0.5))).alias("median_shift"), r6(F.avg("kept")).alias("kept")))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        rf_scores, gbt_scores, logreg_scores, rf_metrics, importance_topk, oof_scores,
        oof_accuracy_by_band, ice_forest, cp_seed_forest, boundary_seeds, interaction_forest,
        explain_forest, replication, kernel_inertness,
    )
}
