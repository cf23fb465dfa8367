"""Registered queries and their SQL twins."""

from modelgraph.plans import classmodel, corpus, definitions, exports, streams, texts  # noqa: F401
from modelgraph.plans.views import ORACLES, QUERIES  # noqa: F401
