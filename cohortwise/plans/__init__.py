"""Named queries over the given tables, each with an equivalent SQL text where one exists."""

from cohortwise.plans import evaluation, learning, ordering, prepare, relate, semisupervised, vectors
from cohortwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "learning", "ordering", "prepare", "relate", "semisupervised", "vectors"]
