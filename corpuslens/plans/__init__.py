"""Registered queries; importing the package fills the registry."""

from . import corpus, inference, reading, records, relational, resampling, validation, variants  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
