"""Registered queries over the shared test tables, with their SQL twins."""

from dyadic.catalog import jobs, joins, latent, models, shaping, statistics  # noqa: F401
from dyadic.catalog.registry import QUERIES, SQL  # noqa: F401
