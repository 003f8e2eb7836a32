"""The queries by theme; each module adds its own to registry.QUERIES and registry.ORACLE_SQL."""

from . import registry  # noqa: F401, I001
from . import arrivals, episodes, exports, frozen, gates, ingest, regimes, scoring, sequential, series, sessions, signals, similarity, states, summaries  # noqa: F401
