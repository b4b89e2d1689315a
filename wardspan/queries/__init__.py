"""All registered queries; importing this package fills the registry."""

from wardspan.queries.registry import ORACLES, QUERIES
from wardspan.queries import alerts, analytics, concepts, evaluation, files, grid, hourly, joins, scoring, sets, streams, text, windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
