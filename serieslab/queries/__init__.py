"""Registered queries over the driver's tables, each with the SQL that it is compared with."""

from serieslab.queries import assessment, catalog, dedup, documents, images, intake, joins, relational, scalars, series, streams, text  # noqa: F401
from serieslab.queries.registry import oracle_sql, queries  # noqa: F401
