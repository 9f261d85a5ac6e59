"""Queries over the given tables, by family; importing this package fills the registry."""

from . import aggregates, feeds, lists, matching, merges, places, records, search, states, text, webintel  # noqa: F401, I001
from . import blobs, detection, feeds_of_users, kept, networks, reports, windows  # noqa: F401
from . import streams, live, saved  # noqa: F401, I001  (they share SQL of the families above)
from .registry import ORACLES, QUERIES  # noqa: F401
