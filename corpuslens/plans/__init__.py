"""Named queries over the test tables; importing this package registers them all."""

from corpuslens.plans import analytics, comparison, corpus, evaluation, modeling, shaping, sources  # noqa: F401
from corpuslens.plans.registry import ORACLE, QUERIES  # noqa: F401
