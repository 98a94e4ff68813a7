"""All registered queries and their SQL."""

from . import base, context, core, more, objects, reviews, shapes, texts  # noqa: F401  (each adds its queries)

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
