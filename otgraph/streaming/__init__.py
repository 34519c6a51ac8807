"""Structured Streaming twins of the batch operators."""

from otgraph.streaming.ingest import *  # noqa: F401,F403
from otgraph.streaming.stateful import *  # noqa: F401,F403
