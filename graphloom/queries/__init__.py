"""Every operator applied to the driver's tables, with the SQL that must agree."""

from . import analysis, code, graph, ranking, reports, search, sources  # noqa: F401
