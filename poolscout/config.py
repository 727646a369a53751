"""Run options and the "whole number or fraction" sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass


def batch_rows(size: int | float, pool_rows: int) -> int:
    """Rows of a batch: an int is taken as is, a fraction of the pool is rounded up."""
    if isinstance(size, float):
        if not 0.0 <= size <= 1.0:
            raise ValueError(f"a fraction must lie in [0, 1], got {size}")
        size = math.ceil(size * pool_rows)
    if size < 0:
        raise ValueError(f"a size must not be negative, got {size}")
    return size


def top_k_rows(k: int | float, pool_rows: int) -> int:
    """k as a row count: a fraction is rounded down, at least 1 and at most the pool."""
    if isinstance(k, float):
        k = max(1, int(k * pool_rows))
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    return min(k, max(pool_rows, 1))


def budget_rows(budget: int | float, pool_rows: int) -> int:
    """Allowed number of labels: a fraction is rounded down."""
    if isinstance(budget, float):
        budget = int(budget * pool_rows)
    if budget <= 0:
        raise ValueError(f"the budget must be positive, got {budget}")
    return budget


@dataclass(frozen=True)
class RunConfig:
    """Options of one exploration. Sizes are row counts (int) or fractions of the full pool (float)."""

    metric: str = "greedy"
    init_size: int | float = 0.01
    batch_sizes: tuple[int | float, ...] = (0.01,)
    epsilon: float = 0.0
    beta: float = 2.0
    xi: float = 0.01
    threshold: float = float("-inf")
    temp_i: float | None = None
    temp_f: float = 1.0
    seed: int = 42
    k: int | float = 0.0005
    window: int = 3
    delta: float = 0.01
    max_iters: int = 10
    budget: int | float = 1.0
    retrain: bool = True
    prune: bool = False
    prune_min_hit_prob: float = 0.025
    use_observed_threshold: bool = False
    checkpoint_every: int = 1

    def __post_init__(self) -> None:
        if not 0.0 <= self.epsilon <= 1.0:
            raise ValueError(f"epsilon must lie in [0, 1], got {self.epsilon}")
        if not 0.0 <= self.prune_min_hit_prob <= 1.0:
            raise ValueError(f"prune_min_hit_prob must lie in [0, 1], got {self.prune_min_hit_prob}")
        if not self.batch_sizes:
            raise ValueError("at least one batch size is needed")

    def batch_size(self, iteration: int) -> int | float:
        """Size of batch ``iteration`` (from 0); the last one repeats."""
        return self.batch_sizes[min(iteration, len(self.batch_sizes) - 1)]
