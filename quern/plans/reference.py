"""All queries of the record-identification operators, with their SQL."""

from quern.plans import aggregates, evaluation, filters, joins, ranking, similarity, sources  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
