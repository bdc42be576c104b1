"""The boards over stored tables, each one lazy frame that reads only the columns it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from learnlens.config import Rules
from learnlens.plans import serving
from learnlens.sources.tables import Warehouse


class Boards:
    """``users`` and ``problems`` are metadata with their keys named for joins."""

    def __init__(self, warehouse: Warehouse, users: DataFrame, problems: DataFrame, rules: Rules | None = None):
        self.warehouse = warehouse
        self.users = users
        self.problems = problems
        self.rules = rules or Rules()

    def _leaderboard(self) -> DataFrame:
        return self.warehouse.read_current("gold_live_leaderboard")

    def _heatmap(self) -> DataFrame:
        return self.warehouse.read("gold_difficulty_heatmap")

    def _profiles(self) -> DataFrame:
        return self.warehouse.read("gold_adaptive_difficulty_profiles")

    def leaderboard(self, limit: int | None = 10, as_of: Column | None = None) -> DataFrame:
        """``as_of``: the moment that ages are told from, ``current_timestamp()`` for a live board."""
        return serving.leaderboard(self._leaderboard(), self.users, limit, as_of)

    def leaderboard_kpis(self) -> DataFrame:
        return serving.leaderboard_kpis(self._leaderboard(), self.users)

    def quick_stats(self) -> DataFrame:
        engagement = self.warehouse.read("gold_engagement_scores")
        return serving.quick_stats(self._leaderboard(), self._heatmap(), engagement, self.rules)

    def heatmap(self, limit: int | None = 12) -> DataFrame:
        return serving.heatmap(self._heatmap(), self.problems, limit)

    def failure_rollup(self) -> DataFrame:
        return serving.failure_rollup(self._heatmap(), self.problems)

    def failure_share(self) -> DataFrame:
        return serving.failure_share(self._heatmap())

    def revenue(self) -> DataFrame:
        return serving.revenue(self.warehouse.read("gold_subscription_revenue"))

    def revenue_totals(self) -> DataFrame:
        return serving.revenue_totals(self.warehouse.read("gold_subscription_revenue"))

    def instructors(self) -> DataFrame:
        return serving.instructors(self.warehouse.read("gold_instructor_report_card"))

    def risk(self, limit: int | None = None) -> DataFrame:
        predictions = self.warehouse.read("gold_dropout_predictions")
        return serving.risk_board(predictions, self.users, self._profiles(), limit)

    def recommendations(self, limit: int | None = 100) -> DataFrame:
        chosen = self.warehouse.read("gold_next_problem_recommendations")
        return serving.recommendation_board(chosen, self.users, self.problems, self._profiles(), limit)

    def tier_distribution(self) -> DataFrame:
        chosen = self.warehouse.read("gold_next_problem_recommendations")
        return serving.tier_distribution(chosen, self._profiles())

    def alerts(self, limit: int | None = 50) -> DataFrame:
        return serving.alert_feed(self.warehouse.read_alerts(), self.users, limit)

    def alert_counts(self) -> DataFrame:
        return serving.alert_counts(self.warehouse.read_alerts())
