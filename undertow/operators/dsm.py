"""The order of a design-structure matrix."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.numbering import numbered
from undertow.operators.scc import condensation
from undertow.operators.weak import weak_components
from undertow.runtime import materialize


def _heap_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(weak, src, dst) sorted by weak, edges of one acyclic graph after another, to (label, place, peak) of its nodes.

    Of the nodes with nothing left before them, the least comes next. peak is the greatest label so far.
    """
    weak, edges = None, []

    def ordered() -> pa.RecordBatch:
        waiting: dict[str, int] = {}
        after: dict[str, list[str]] = {}
        for src, dst in edges:
            waiting.setdefault(src, 0)
            waiting[dst] = waiting.get(dst, 0) + 1
            after.setdefault(src, []).append(dst)
        ready = [n for n, k in waiting.items() if not k]
        heapq.heapify(ready)
        labels, peaks, peak = [], [], ""
        while ready:
            label = heapq.heappop(ready)
            peak = max(peak, label)
            labels.append(label)
            peaks.append(peak)
            for n in after.get(label, ()):
                waiting[n] -= 1
                if not waiting[n]:
                    heapq.heappush(ready, n)
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(range(len(labels)), pa.int64()), pa.array(peaks, pa.string())], names=["label", "place", "peak"])

    for batch in batches:
        for key, src, dst in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key != weak and edges:
                yield ordered()
                edges = []
            weak = key
            edges.append((src, dst))
    if edges:
        yield ordered()


def component_order(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, peak, place) of labels(label) and acyclic edges (src, dst): sorted by peak and place, the order of one heap over all.

    That heap always takes the least label with nothing left before it. Weakly connected parts do not
    wait for each other, so it takes each part in the order of the part's own heap, and chooses
    among the parts' next labels the least. Hence a label comes when all labels up to the greatest before it in
    its own part (its peak) have come or cannot yet; merging by peak gives the same order, and
    parts are ordered each in a task of its own.
    """
    linked = materialize(weak_components(edges), "weak")
    placed = edges.join(linked.select(F.col("node").alias("src"), "weak"), "src").select("weak", "src", "dst")
    placed = placed.repartition("weak").sortWithinPartitions("weak").mapInArrow(_heap_orders, "label string, place long, peak string")
    alone = labels.join(linked.select(F.col("node").alias("label")), "label", "left_anti")
    return placed.unionByName(alone.select("label", F.lit(0).cast("long").alias("place"), F.col("label").alias("peak")))


def dsm_order(graph: Graph, parts: DataFrame) -> DataFrame:
    """(ordinal, path, block): the smallest topological order of components, members by path.

    Components are taken by their smallest path whenever nothing before them is left (see
    component_order). block numbers the components of two or more nodes in the order in which they
    stand, from 0, and is null for single nodes.
    """
    order = component_order(parts.select("label").distinct(), condensation(graph, parts))
    sizes = parts.groupBy("label").agg(F.count("*").alias("size"))
    order = materialize(order.join(sizes, "label"), "order")
    blocks = numbered(order.filter("size >= 2").select("label", "peak", "place"), ["peak", "place"], "block").select("label", "block")
    members = parts.select("id", "path", "label").join(order.select("label", "peak", "place"), "label")
    out = numbered(members, ["peak", "place", "path", "id"], "ordinal").join(blocks, "label", "left")
    return out.select("ordinal", "path", "block")
