"""All registered queries, imported in one place."""

from . import registry, runs, sources_q, stream_q, upkeep_q  # noqa: F401  (modules register their queries)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
