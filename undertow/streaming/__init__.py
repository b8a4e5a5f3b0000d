"""Streams of edge changes."""

from undertow.streaming.edge_feed import CHANGE_SCHEMA, EdgeFeed

__all__ = ["CHANGE_SCHEMA", "EdgeFeed"]
