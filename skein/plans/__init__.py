"""Registered queries of the engine's operators."""

from skein.plans import changes, chunks, retrieval, scalars, stores  # noqa: F401
from skein.plans.registry import ORACLES as _O
from skein.plans.registry import QUERIES as _Q

QUERIES = changes.QUERIES | _Q
ORACLES = changes.ORACLES | _O
