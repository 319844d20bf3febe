"""Importing the query modules fills the registry."""

from roomgraph.plans import (  # noqa: F401
    further_queries,
    learning_queries,
    question_queries,
    scene_queries,
    stream_queries,
)
from roomgraph.plans.catalog import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "where_is"
