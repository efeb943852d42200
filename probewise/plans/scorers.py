"""Scorers: P(class 1) of a row, in the forms a Spark user has at hand.

``ExpressionScorer`` is SQL text with named features, so Catalyst sees through it and a
swept feature is just another column in the text. ``MLScorer`` wraps a fitted pipeline,
``PandasScorer`` any vectorised matrix function, ``BatchScorer`` a model that workers load themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class ExpressionScorer:
    """``edges`` names, for a scorer that only steps, the values of a feature at which it does (z > edge),
    as numbers or SQL text; ``seen`` is SQL for what a scorer reads of a feature where that is less than its value."""

    def __init__(
        self, template: str, features: list[str], edges: dict[str, list[float | str]] | None = None,
        seen: dict[str, str] | None = None,
    ):
        self.template = template
        self.features = features
        self.edges = edges or {}
        self.seen = seen or {}

    def edge_columns(self, feature: str) -> list[Column]:
        return [F.expr(e) if isinstance(e, str) else F.lit(float(e)) for e in self.edges[feature]]

    def seen_column(self, feature: str) -> Column:
        """Equal for values of the feature that the scorer cannot tell apart."""
        if feature in self.seen:
            return F.expr(self.seen[feature])
        passed = [F.when(F.col(feature) > e, 1).otherwise(0) for e in self.edge_columns(feature)]
        return sum(passed, F.lit(0))

    def sql(self, replace: dict[str, str] | None = None) -> str:
        return self.template.format(**{f: f for f in self.features} | (replace or {}))

    def column(self, replace: dict[str, str] | None = None) -> Column:
        return F.expr(self.sql(replace))

    def swept_sql(self, at: str, features: list[str]) -> str:
        """Score text with the row's swept feature (column ``feature``) read from ``at``."""
        if len(features) == 1:
            return self.sql({features[0]: at})
        pick = "(CASE WHEN feature = '{f}' THEN {at} ELSE {f} END)"
        return self.sql({f: pick.format(f=f, at=at) for f in features})

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, self.column())

    def score_at(self, df: DataFrame, at: str, features: list[str], out: str = "p") -> DataFrame:
        swept = [f for f in features if f in self.features]
        if len(features) == 1:
            return df.withColumn(out, self.column({f: at for f in swept}))
        # pick each feature's value once per point, below the many terms that read it
        picked = {
            f"_at_{f}": F.when(F.col("feature") == f, F.col(at)).otherwise(F.col(f)) for f in swept
        }
        points = df.withColumns(picked)
        return points.withColumn(out, self.column({f: f"_at_{f}" for f in swept})).drop(*picked)


class RowScorer:
    """Scorers that need the overwritten row itself rather than an expression."""

    features: list[str]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        raise NotImplementedError

    def score_at(self, df: DataFrame, at: str, features: list[str], out: str = "p") -> DataFrame:
        own = {f"_own_{f}": F.col(f) for f in features}
        swept = {
            f: F.when(F.col("feature") == f, F.col(at)).otherwise(F.col(f)) for f in features
        }
        scored = self.score(df.withColumns(own).withColumns(swept), out)
        back = {f: F.col(f"_own_{f}") for f in features}
        return scored.withColumns(back).drop(*own)


class MLScorer(RowScorer):
    def __init__(self, model, features: list[str]):
        self.model = model
        self.features = features

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        before = df.columns
        scored = self.model.transform(df)
        return scored.select(*before, vector_to_array("probability")[1].alias(out))


class PandasScorer(RowScorer):
    def __init__(self, fn: Callable[[np.ndarray], np.ndarray], features: list[str]):
        self.fn = fn
        self.features = features

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        fn = self.fn

        @F.pandas_udf("double")
        def scored(block: pd.DataFrame) -> pd.Series:
            return pd.Series(fn(block.to_numpy(dtype=float)))

        return df.withColumn(out, scored(F.struct(*[F.col(f) for f in self.features])))


class BatchScorer(RowScorer):
    """An outside model that is loaded once per Python worker and scores batches of rows.

    ``load`` takes nothing and returns a function from a rows x features matrix to P(class 1); it runs in
    the worker, so a model that is a file or needs its own library never passes through the driver.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], features: list[str], batch_size: int = 4096):
        self.load, self.features, self.batch_size = load, features, batch_size

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        predict = predict_batch_udf(
            self.load, return_type=DoubleType(), batch_size=self.batch_size, input_tensor_shapes=[[len(self.features)]]
        )
        return df.withColumn(out, predict(F.array(*[F.col(f).cast("double") for f in self.features])))


def number(v: float) -> str:
    """A DOUBLE literal in both Spark SQL and ANSI engines (bare decimals are DECIMAL)."""
    return f"{v!r}e0" if v >= 0 else f"({v!r}e0)"


def staircase(base: float, stairs: list[tuple], shift: str = "") -> str:
    """Sum of stumps by rule: (feature, start, gap, count, lift) adds at start + gap * i a
    step of lift times a factor that cycles through 1.0 .. 1.6, so heights differ."""
    terms = [number(base)]
    for feature, start, gap, count, lift in stairs:
        for i in range(count):
            height = round(lift * (1 + 0.1 * ((5 * i) % 7)), 6)
            edge = number(round(start + gap * i, 6))
            terms.append(
                f"CASE WHEN {{{feature}}} > {edge}{shift} THEN {number(height)} ELSE 0e0 END"
            )
    return " + ".join(f"({t})" if "CASE" in t else t for t in terms)


def stair_edges(stairs: list[tuple]) -> dict[str, list[float]]:
    """Where a staircase steps, by feature."""
    return {f: [round(start + gap * i, 6) for i in range(count)] for f, start, gap, count, _ in stairs}


_ORDER_STAIRS = [("qty", 15.5, 19.7, 12, 0.032), ("gross", 60000.25, 81000.0, 6, -0.038)]
_ORDER_EDGES = stair_edges(_ORDER_STAIRS)

ORDER_STAIRS = ExpressionScorer(
    staircase(0.40, _ORDER_STAIRS)
    + " + (CASE WHEN {avg_disc} > 0.0525e0 AND {qty} > 110.25e0 THEN (-0.13e0) ELSE 0e0 END)"
    + " + (CASE WHEN {avg_disc} > 0.0305e0 THEN 0.05e0 ELSE 0e0 END)",
    ["qty", "gross", "avg_disc"],
    _ORDER_EDGES | {"qty": sorted([*_ORDER_EDGES["qty"], 110.25]), "avg_disc": [0.0305, 0.0525]},
)

ORDER_LOGIT = ExpressionScorer(
    "1e0 / (1e0 + exp(-(0.15e0 + 0.9e0 * ({qty} - 103e0) / 57e0"
    " - 0.6e0 * ({gross} - 216000e0) / 119000e0 + 0.5e0 * ({avg_disc} - 0.05e0) / 0.0168e0)))",
    ["qty", "gross", "avg_disc"],
)

_DOC_STAIRS = [("n_words", 24.5, 61.0, 12, 0.03), ("n_chars", 190.5, 610.0, 8, -0.026)]

DOC_STAIRS = ExpressionScorer(
    staircase(0.38, _DOC_STAIRS)
    + " + (CASE WHEN {chars_per_word} > 6.2003e0 THEN (-0.07e0) ELSE 0.04e0 END)",
    ["n_words", "n_chars", "chars_per_word"],
    stair_edges(_DOC_STAIRS) | {"chars_per_word": [6.2003]},
)

DOC_LOGIT = ExpressionScorer(
    "1e0 / (1e0 + exp(-(0.2e0 + 1.1e0 * ({n_words} - 390e0) / 514e0"
    " - 0.7e0 * ({n_chars} - 2447e0) / 3159e0 - 0.8e0 * ({chars_per_word} - 6.41e0) / 0.8e0)))",
    ["n_words", "n_chars", "chars_per_word"],
)


def doc_stairs_shifted(seed: str) -> ExpressionScorer:
    """The document staircase with every edge moved by ``seed``: stands for a refit."""
    shift = f" + 1.71e0 * {seed}"
    edges = {f: [f"{number(e)}{shift}" for e in at] for f, at in stair_edges(_DOC_STAIRS).items()}
    return ExpressionScorer(staircase(0.38, _DOC_STAIRS, shift=shift), ["n_words", "n_chars"], edges)


def interaction_scorer(strength: str) -> ExpressionScorer:
    """Effect of qty whose sign is flipped by gross to the degree ``strength`` (0 .. 1)."""
    text = (
        "1e0 / (1e0 + exp(-2e0 * (({qty} - 103e0) / 57e0)"
        f" * ((1e0 - {strength}) + {strength} * sign({{gross}} - 200000.5e0))))"
    )
    return ExpressionScorer(text, ["qty", "gross"], seen={"gross": "sign(gross - 200000.5e0)"})
