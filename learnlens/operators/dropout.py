"""Dropout risk: logistic regression over the user features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.config import Learning, Rules
from learnlens.functions import rules as R
from learnlens.operators.features import class_balance, with_label

# The model inputs, in order.
MODEL_INPUTS = (
    "total_submissions",
    "solved_count",
    "failed_count",
    "login_minutes",
    "avg_exec_ms",
    "fail_rate_pct",
)


def banded(scored: DataFrame, rules: Rules) -> DataFrame:
    return scored.select(
        "user_id",
        "dropout_probability",
        R.risk_band(F.col("dropout_probability"), rules).alias("risk_label"),
    )


def constant(labelled: DataFrame, rules: Rules) -> DataFrame:
    """Scores without a model, for when all users carry the same label."""
    probability = R.single_class_probability(F.col("label"), rules)
    return banded(labelled.select("user_id", probability.alias("dropout_probability")), rules)


def _fitted(labelled: DataFrame, learning: Learning) -> PipelineModel | None:
    """The regression over the label, or None if all users carry the same."""
    if len(class_balance(labelled).take(2)) < 2:  # two rows at most
        return None
    regression = LogisticRegression(
        maxIter=learning.lr_max_iter,
        regParam=learning.lr_reg_param,
        elasticNetParam=learning.lr_elastic_net,
    )
    assembler = VectorAssembler(inputCols=list(MODEL_INPUTS), outputCol="features")
    return Pipeline(stages=[assembler, regression]).fit(labelled)


def _probability() -> Column:
    return vector_to_array("probability")[1]


def predictions(features: DataFrame, rules: Rules, learning: Learning) -> DataFrame:
    """Score every user by a model trained on the rule label of the same users.

    ``features`` is read several times: pass a stored table, not a long plan.
    """
    labelled = with_label(features, rules)
    model = _fitted(labelled, learning)
    if model is None:
        return constant(labelled, rules)
    scored = model.transform(labelled).select("user_id", _probability().alias("dropout_probability"))
    return banded(scored, rules)


def weights(features: DataFrame, rules: Rules, learning: Learning) -> DataFrame:
    """``(term, weight, gradient)`` of the model: what it has learned, and how far from the optimum it is.

    Weights are per standard deviation of their input and the intercept is that of a user with mean
    inputs, so they compare with each other.  The gradient is that of the mean loss with its
    penalty, taken over all users: zero at the optimum.  No rows if there is no model.
    """
    spark = features.sparkSession
    labelled = with_label(features, rules)
    model = _fitted(labelled, learning)
    if model is None:
        return spark.createDataFrame([], "term string, weight double, gradient double")
    spread = labelled.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in MODEL_INPUTS],
        *[F.stddev_samp(name).alias(f"spread_{name}") for name in MODEL_INPUTS],
    ).first()
    regression = model.stages[1]
    learned = dict(zip(MODEL_INPUTS, regression.coefficients.toArray().tolist(), strict=True))
    scaled = {name: learned[name] * spread[f"spread_{name}"] for name in MODEL_INPUTS}
    level = regression.intercept + sum(learned[name] * spread[f"mean_{name}"] for name in MODEL_INPUTS)

    off = _probability() - F.col("label")
    penalty = learning.lr_reg_param * (1 - learning.lr_elastic_net)
    gradients = {"intercept": F.avg(off)}
    for name in MODEL_INPUTS:
        if spread[f"spread_{name}"]:  # an input that is the same for all has no weight
            moved = (F.col(name) - spread[f"mean_{name}"]) / spread[f"spread_{name}"]
            gradients[name] = F.avg(off * moved) + penalty * scaled[name]
    found = model.transform(labelled).agg(*[g.alias(name) for name, g in gradients.items()]).first()
    rows = [(name, {"intercept": level, **scaled}[name], found[name]) for name in gradients]
    return spark.createDataFrame(rows, "term string, weight double, gradient double")
