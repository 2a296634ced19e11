"""Query catalogue: every operator run on the driver's tables, with its DuckDB twin."""

from ampfold.catalog.registry import ORACLE, QUERIES, register  # noqa: F401
from ampfold.catalog import cycles_q, model_q, sessions_q, signals_q  # noqa: F401  (registration side effects)
