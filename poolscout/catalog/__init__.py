"""Every registered query, with the SQL that must give the same rows where there is one."""

from . import acquisition, analysis, models, pools, similarity, statistics  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
