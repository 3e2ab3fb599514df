"""All registered queries."""

from __future__ import annotations

from . import catalogue_queries, frame_queries, graph_queries, raster_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
