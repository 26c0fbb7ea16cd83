"""All queries of the engine with their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from sampleworks.plans import calculations, detection, evaluation, exchanging, facets, governing, history, judging, neighbours, pictures, shapes, summing, versions  # noqa: F401
from sampleworks.plans.register import ORACLE_SQL, QUERIES, Query, query, table  # noqa: F401
