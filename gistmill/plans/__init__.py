"""Named queries over the given tables."""

from . import texts, outputs, records, rollups, streams, landed, experiments, analyses  # noqa: F401, I001
from .registry import QUERIES, SQL  # noqa: F401
