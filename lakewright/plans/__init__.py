"""Named queries over the given tables. Importing this package registers them all."""

from . import catalogue, corpus, forecast, marts, parsing, scoring, selection, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
