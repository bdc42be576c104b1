"""Next problem for each user, by alternating least squares on implicit ratings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.config import Learning
from learnlens.operators.numbering import numbered
from learnlens.session import staged


_SCHEMA = "user_id string, recommended_problem_id string, recommendation_score double"


@dataclass(frozen=True)
class Factors:
    """A fitted model and the numbers of its users and problems."""

    model: ALSModel
    ratings: DataFrame
    users: DataFrame
    problems: DataFrame

    def named(self, chosen: DataFrame) -> DataFrame:
        """``(user_number, problem_number, score)`` by the names of both."""
        return (
            chosen.join(self.users, "user_number", "left")
            .join(self.problems, "problem_number", "left")
            .select(
                "user_id",
                F.col("problem_id").alias("recommended_problem_id"),
                F.round(F.col("score").cast("double"), 4).alias("recommendation_score"),
            )
        )


def fitted(interactions: DataFrame, learning: Learning) -> Factors:
    """``interactions`` is read several times: pass a stored table."""
    users = staged(numbered(interactions, "user_id", "user_number", learning.id_buckets), "als-users")
    problems = staged(numbered(interactions, "problem_id", "problem_number", learning.id_buckets), "als-problems")
    ratings = interactions.join(users, "user_id").join(problems, "problem_id")
    ratings = ratings.select("user_number", "problem_number", "rating")

    als = ALS(
        userCol="user_number",
        itemCol="problem_number",
        ratingCol="rating",
        implicitPrefs=True,
        nonnegative=True,
        coldStartStrategy="drop",
        rank=learning.als_rank,
        maxIter=learning.als_max_iter,
        regParam=learning.als_reg_param,
        alpha=learning.als_alpha,
        seed=learning.als_seed,
        numUserBlocks=learning.als_user_blocks,
        numItemBlocks=learning.als_item_blocks,
        checkpointInterval=4,
    )
    return Factors(als.fit(ratings), ratings, users, problems)


def next_problem(interactions: DataFrame, learning: Learning) -> DataFrame:
    """The best problem of every user who passed one; an empty frame when nobody did.

    Problems already solved may be recommended again, unless ``learning.exclude_solved``.
    ``interactions`` is read several times: pass a stored table.
    """
    if interactions.isEmpty():
        return interactions.sparkSession.createDataFrame([], _SCHEMA)
    factors = fitted(interactions, learning)
    if learning.exclude_solved:
        return factors.named(best_unsolved(factors))
    best = factors.model.recommendForAllUsers(1)
    return factors.named(best.select("user_number", F.inline("recommendations").alias("problem_number", "score")))


def best_unsolved(factors: Factors) -> DataFrame:
    """The best problem that the user has not solved; no row for users who solved all.

    Every user gets as long a list as it takes: lists of two first, and lists four times as long for
    those users alone whose list held solved problems only.
    """
    wanted = staged(factors.ratings.select("user_number").distinct(), "unsolved-users")
    solved = factors.ratings.select("user_number", "problem_number").distinct()
    problems = factors.problems.count()
    found, length = [], 2
    while True:
        lists = factors.model.recommendForUserSubset(wanted, min(length, problems))
        listed = lists.select("user_number", F.inline("recommendations").alias("problem_number", "score"))
        fresh = listed.join(solved, ["user_number", "problem_number"], "left_anti")
        best = fresh.groupBy("user_number").agg(
            F.max(F.struct(F.col("score"), (-F.col("problem_number")).alias("order"), "problem_number")).alias("best")
        )
        best = best.select("user_number", "best.problem_number", "best.score")
        found.append(staged(best, f"unsolved-{length}"))
        wanted = staged(wanted.join(found[-1], "user_number", "left_anti"), f"unsolved-users-{length}")
        if length >= problems or wanted.isEmpty():
            return reduce(DataFrame.unionByName, found)
        length *= 4


def unbalanced_users(factors: Factors, learning: Learning, tolerance: float = 1e-3) -> DataFrame:
    """Users whose factors are not the best for the problems' factors: ``(user_number, worst)``.

    The factors of a user minimise a quadratic under the condition that none is negative.  At the
    minimum the gradient is zero where a factor is positive and not negative where it is zero; ``worst`` is how
    far it is from that, as a part of the right-hand side of the user's normal equations.
    """
    rank = range(learning.als_rank)
    items = factors.model.itemFactors.select(
        F.col("id").alias("problem_number"), *[F.col("features")[i].cast("double").alias(f"y{i}") for i in rank]
    )
    pairs = [(i, j) for i in rank for j in rank if i <= j]
    # numbers as many as the rank squared, whatever the size of the tables
    whole = items.agg(*[F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"w{i}_{j}") for i, j in pairs])
    confidence = learning.als_alpha * F.col("rating")
    own = factors.ratings.join(items, "problem_number").groupBy("user_number").agg(
        F.count("*").alias("n"),
        *[F.sum(confidence * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum((1 + confidence) * F.col(f"y{i}")).alias(f"b{i}") for i in rank],
    )
    users = factors.model.userFactors.select(
        F.col("id").alias("user_number"), *[F.col("features")[i].cast("double").alias(f"x{i}") for i in rank]
    )
    rows = users.join(own, "user_number").join(F.broadcast(whole))  # one row

    def gradient(i: int) -> Column:
        total = learning.als_reg_param * F.col("n") * F.col(f"x{i}") - F.col(f"b{i}")
        for j in rank:
            a, b = min(i, j), max(i, j)
            total = total + (F.col(f"w{a}_{b}") + F.col(f"a{a}_{b}")) * F.col(f"x{j}")
        return total

    scale = F.greatest(*[F.abs(F.col(f"b{i}")) for i in rank], F.lit(1e-12))
    off = [F.when(F.col(f"x{i}") > 0, F.abs(gradient(i))).otherwise(F.greatest(-gradient(i), F.lit(0.0))) for i in rank]
    negative = F.least(*[F.col(f"x{i}") for i in rank]) < 0
    worst = F.when(negative, F.lit(float("inf"))).otherwise(F.greatest(*off) / scale)
    return rows.select("user_number", worst.alias("worst")).filter(F.col("worst") > tolerance)
