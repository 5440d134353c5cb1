"""Registered queries, by theme. Importing this package fills the registry."""

from tinderframe.catalog import clean, evaluate, models, series, spatial, stores  # noqa: F401
from tinderframe.catalog.inputs import ORACLES, QUERIES  # noqa: F401
