"""Readers and stores: graph documents, the graph store, diffs, workspaces, table projections."""
