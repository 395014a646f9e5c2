"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from . import registry
from .functions import collection, conditional, dates, json_xml, maths, misc, strings  # noqa: F401
from .operators import aggregates, aggregator, graph_generators, graph_tools, graphs, joins, learning, mllib, projection, rdd_style, sets, sorting, statistics, udfs, windows  # noqa: F401
from .plans import commands, debug_queries, measures, provenance_queries  # noqa: F401
from .sources import connectors, database, delimited, options, pushdown  # noqa: F401
from .streaming import feed, online  # noqa: F401
from .streaming import more as more_streaming  # noqa: F401
from .streaming import queries as streaming_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
