"""Every threshold and option of the engine, in two frozen dataclasses."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    """Business rules.  Fixed values: the defaults decide the results."""

    # dropout label
    label_fail_rate: float = 65.0
    label_login_minutes: float = 35.0
    label_solved: int = 12
    # dropout risk bands
    risk_high: float = 0.7
    risk_medium: float = 0.45
    # probability given to everybody when all users carry the same label
    single_class_positive: float = 0.8
    single_class_negative: float = 0.2
    # performance tiers
    novice_solved: int = 12
    novice_fail_rate: float = 65.0
    intermediate_solved: int = 35
    intermediate_fail_rate: float = 35.0
    # engagement score weights
    points_per_login_minute: float = 4.0
    points_per_solved: float = 18.0
    # alerts
    latency_ms: float = 5000.0
    burst_submissions: int = 2
    burst_ips: int = 1
    burst_window: str = "30 seconds"
    burst_slide: str = "10 seconds"
    watermark: str = "2 minutes"
    sketch_bits: int = 12  # of address sketches: 4096 registers, 1.3 % standard error
    # status line
    low_engagement: int = 100


@dataclass(frozen=True)
class Learning:
    """Model parameters.  Fixed values, but for the seed, the buckets and the blocks.

    ``id_buckets`` and the blocks decide which factors start where, so results follow from the data
    and these values alone, whatever the cluster.  Choose a block per few million
    ratings: all ratings of a block are the work of one task.
    """

    lr_max_iter: int = 30
    lr_reg_param: float = 0.05
    lr_elastic_net: float = 0.0
    als_rank: int = 8
    als_max_iter: int = 8
    als_reg_param: float = 0.08
    als_alpha: float = 1.0
    als_seed: int = 7
    id_buckets: int = 1024
    als_user_blocks: int = 16
    als_item_blocks: int = 16
    exclude_solved: bool = False  # True: never recommend what the user has solved


@dataclass(frozen=True)
class Settings:
    """Where tables live and how the batch and the streams run."""

    root: str
    checkpoint_base: str | None = None
    reset_gold: bool = True
    keep_snapshots: int = 2
    # streams
    source_kind: str = "kafka"
    source_path: str | None = None
    source_format: str = "text"
    max_files_per_trigger: int | None = None
    kafka_bootstrap: str = "localhost:9092"
    submissions_topic: str = "raw_submissions"
    metrics_topic: str = "system_metrics"
    starting_offsets: str = "latest"
    fail_on_data_loss: bool = True
    max_offsets_per_trigger: int = 0  # no cap
    stream_shuffle_partitions: int = 32
    count_state_rows: bool = True  # False: progress reports do not tell the rows of the state
    stream_reset: bool = False
    stream_reset_keeps_tables: bool = False
    approximate_addresses: bool = False
    alert_once_a_minute: bool = False  # True: one burst alert per user and minute
    compact_every: int = 100
    trigger_interval: str = "10 seconds"  # empty: a batch as soon as the one before has ended
    rules: Rules = field(default_factory=Rules)
    learning: Learning = field(default_factory=Learning)

    @property
    def checkpoints(self) -> str:
        return self.checkpoint_base or f"{self.root}/_checkpoints"

    @classmethod
    def from_env(cls, root: str, env: Mapping[str, str] | None = None, **overrides) -> Settings:
        """Read the option surface from the environment; ``overrides`` win."""
        env = os.environ if env is None else env
        values: dict = {}
        for name, (option, convert) in _ENV_OPTIONS.items():
            if name in env:
                values[option] = convert(env[name])
        values.update(overrides)
        return cls(root=root, **values)


def _flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "y", "on")


# Names of the environment options.
_ENV_OPTIONS = {
    "BATCH_RESET_GOLD": ("reset_gold", _flag),
    "KAFKA_BOOTSTRAP_SERVERS": ("kafka_bootstrap", str),
    "STREAM_CHECKPOINT_BASE": ("checkpoint_base", str),
    "STREAM_STARTING_OFFSETS": ("starting_offsets", str),
    "STREAM_FAIL_ON_DATA_LOSS": ("fail_on_data_loss", _flag),
    "STREAM_MAX_OFFSETS_PER_TRIGGER": ("max_offsets_per_trigger", int),
    "STREAM_SHUFFLE_PARTITIONS": ("stream_shuffle_partitions", int),
    "STREAM_TRIGGER_INTERVAL": ("trigger_interval", str),
    "STREAM_RESET": ("stream_reset", _flag),
    "STREAM_RESET_SKIP_DB_CLEAR": ("stream_reset_keeps_tables", _flag),
}
