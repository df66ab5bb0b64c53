"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

1. Equal vectors of a label become one node with a count.
2. Each label is clustered (centroids from a bounded sample, ``SAMPLE_PER_CENTROID``);
   every node joins the shards of its ``overlap`` nearest centroids, of which the
   nearest is its home. A shard of over ``MAX_SHARD`` nodes is clustered once more by
   centroids of its own. What is still larger (more near copies than that) is cut into
   slices and becomes one unit for each pair of slices, so no task holds an unbounded
   group and no pair is left out.
3. In each unit a graph with robust-pruned lists is built. Candidates of a node
   come from the ``PROBES`` pivot groups nearest to its own, not from all nodes. The
   lists of a node are united over its units.
4. In its home every node is a query: a greedy search from medoids walks the united
   lists to it and then expands over everything within the range. The queries of a
   unit walk in step. What they find is verified with cosines in double precision.
5. A unit returns for each node its number of links and one tree edge, never its
   pairs. A pair that two homes can find is counted by the first of them.
6. The recall of ``AUDIT_QUERIES`` queries is audited against all nodes; below
   ``MIN_RECALL`` the graph is built again with twice the overlap, and over
   ``MAX_OVERLAP`` an error tells the recall reached.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without a label, link with nothing and are their own
component. Vectors of different lengths do not link. Repeated rows are vectors
of their own: they link with each other. Columns other than the three named are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.components import connected_components, hub_limit, split_join
from scoreloom.llm.shared import materialize

THRESHOLD = 0.93
SHARD_NODES = 600
MAX_SHARD = 3000
MAX_CENTROIDS = 1 << 12
SAMPLE_PER_CENTROID = 24
#: Bits of a shard's number that tell its part.
SECOND_BITS = 12
#: Nodes of a large shard that one task assigns to its second centroids.
ASSIGN_ROWS = 50_000
OVERLAP, MAX_OVERLAP = 3, 64
DEGREE = 20
CANDIDATES = 64
PROBES = 6
ALPHA = 1.2
BEAM = 12
ENTRIES = 8
#: Similarities that a search holds at once.
CELLS = 1 << 22
AUDIT_QUERIES = 1024
MIN_RECALL = 0.97


def _unit_rows(vectors) -> np.ndarray:
    x = np.array(vectors.tolist() if hasattr(vectors, "tolist") else vectors, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``."""
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        centers[full] = sums[full] / norms[full, None]
    return centers


def near_candidates(x: np.ndarray, count: int = CANDIDATES, probes: int = PROBES) -> np.ndarray:
    """The nearest rows of each row (``-1``: none), nearest first, among the pivot groups around its own."""
    n = len(x)
    found = np.full((n, count), -1, np.int64)
    pivots = x[np.unique(np.arange(int(np.sqrt(n))) * n // max(1, int(np.sqrt(n))))] if n else x
    own = (x @ pivots.T).argmax(axis=1) if n else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(pivots) + 1))
    groups = [order[edges[g] : edges[g + 1]] for g in range(len(pivots))]
    around = np.argsort(-(pivots @ pivots.T), axis=1, kind="stable")[:, :probes]
    for g, members in enumerate(groups):
        others = np.concatenate([groups[h] for h in around[g]])
        for at in range(0, len(members), 512):
            rows = members[at : at + 512]
            sims = x[rows] @ x[others].T
            sims[rows[:, None] == others[None, :]] = -np.inf
            c = min(count, len(others) - 1)
            if c > 0:
                top = np.argpartition(-sims, c - 1, axis=1)[:, :c]
                order_of = np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable")
                found[rows, :c] = others[np.take_along_axis(top, order_of, axis=1)]
    return found


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours of each row (``-1``: none): the nearest candidate stays, and those that it is ``alpha`` times nearer to go."""
    lists = np.full((len(x), degree), -1, np.int64)
    candidates = near_candidates(x)
    for at in range(0, len(x), 512):
        near = candidates[at : at + 512]
        rows, own = np.arange(len(near)), x[near]
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rcd,rd->rc", own, x[at : at + 512])))
        alive = near >= 0
        for slot in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            lists[at + rows[some], slot] = near[rows, first][some]
            between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(own, own[rows, first][:, :, None])[:, :, 0]))
            alive &= ~((alpha * between <= distance) & some[:, None])
            alive[rows, first] = False
    return lists


def medoids(x: np.ndarray, count: int = ENTRIES) -> np.ndarray:
    """The row nearest to the middle of all, and those nearest to the middles of a few groups."""
    centers = spherical_kmeans(x, min(count, len(x)), rounds=3)
    return np.unique(np.r_[(x @ x.mean(axis=0)).argmax(), (x @ centers.T).argmax(axis=0)])


def range_search(x: np.ndarray, lists: tuple[np.ndarray, np.ndarray], entries: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query row and a row within ``threshold`` of it, found on the graph.

    ``lists`` holds the ends of the neighbour lists and the neighbours. Each query
    is greedy from the entries, with a beam; every row in range is expanded.
    """
    ends, near = np.r_[0, lists[0]], lists[1]
    n, found = len(x), []
    for at in range(0, len(queries), max(1, CELLS // n)):
        own = queries[at : at + max(1, CELLS // n)]
        q = x[own]
        sims, open_ = np.full((len(own), n), -np.inf), np.zeros((len(own), n), bool)
        sims[:, entries], open_[:, entries] = q @ x[entries].T, True
        while True:
            floor = np.partition(sims, n - beam, axis=1)[:, n - beam, None] if n > beam else -np.inf
            ahead = open_ & ((sims >= floor) | (sims >= threshold))
            rows, nodes = np.nonzero(ahead)
            if not len(rows):
                break
            open_[rows, nodes] = False
            new = []
            for cut in range(0, len(rows), 1 << 16):
                r, node = rows[cut : cut + (1 << 16)], nodes[cut : cut + (1 << 16)]
                count = ends[node + 1] - ends[node]
                to = near[np.repeat(ends[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                key = np.repeat(r, count) * n + to
                new.append(np.unique(key[sims.ravel()[key] == -np.inf]))
            key = np.unique(np.concatenate(new))
            for cut in range(0, len(key), 1 << 16):
                r, node = np.divmod(key[cut : cut + (1 << 16)], n)
                sims[r, node], open_[r, node] = np.einsum("ij,ij->i", q[r], x[node]), True
        rows, nodes = np.nonzero(sims >= threshold)
        found.append((own[rows], nodes))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (queries, queries)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", ignore_index=True)
    ids = pdf["node"].to_numpy()
    lists = robust_prune(_unit_rows(pdf["vec"]))
    return pd.DataFrame({"node": ids, "near": [ids[row[row >= 0]] for row in lists]})


def _both_ways(ids: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lists, and places of neighbours in ``ids``, of the links in either direction."""
    n = len(ids)
    a = np.repeat(np.arange(n), [len(x) for x in near])
    b = pd.Index(ids).get_indexer(np.concatenate(near)) if n else a
    a, b = a[b >= 0], b[b >= 0]
    keys = np.unique(np.r_[a * n + b, b * n + a])
    return np.cumsum(np.bincount(keys // n, minlength=n)), keys % n


def _search(threshold: float):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, n, x = pdf["node"].to_numpy(), len(pdf), _unit_rows(pdf["vec"])
        shard, home = int(pdf["shard"].iloc[0]), pdf["home"].to_numpy()
        queries = np.flatnonzero(home == shard)
        a, b = range_search(x, _both_ways(ids, pdf["near"].tolist()), medoids(x), queries, threshold - 1e-9)
        # Of two queries one speaks; then verify, and leave to the other home the pairs that are its own.
        a, b = a[(a < b) | (a > b) & (home[b] != shard)], b[(a < b) | (a > b) & (home[b] != shard)]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        width = int(pdf["shards"].map(len).max())
        member = np.array([[*h, *[-1] * (width - len(h))] for h in pdf["shards"]])
        good &= (home[b] == shard) | (shard < home[b]) | (member[a] != home[b][:, None]).all(axis=1)
        if int(pdf["slice_a"].iloc[0]) != int(pdf["slice_b"].iloc[0]):
            slices = pdf["slice"].to_numpy()
            good &= slices[a] != slices[b]
        a, b = a[good], b[good]
        copies = pdf["copies"].to_numpy()
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        return pd.DataFrame({"node": ids, "links": links.astype(np.int64), "root": ids[_roots(n, a, b)]})

    return search


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows ``(id, node)``, ``node`` null where it cannot link; and the nodes."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.col(label_col).cast("string")).alias("label"), F.when(fine, vec).alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    nodes = rows.where("vec is not null").groupBy("label", "vec", "node").agg(F.min("id").alias("node_id"), F.count("*").alias("copies"))
    return rows.drop("label", "vec"), nodes


def _centroids(nodes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of each label and length with more than one shard of nodes; at most ``MAX_CENTROIDS`` in all."""
    sizes = nodes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    total = nodes.count()
    target = max(SHARD_NODES, -(-total // MAX_CENTROIDS))
    sizes = sizes.where(F.col("n") > target).withColumn("k", F.ceil(F.col("n") / target))
    wanted = F.col("k") * SAMPLE_PER_CENTROID / F.col("n")
    # Labels of more than ``target`` nodes: ``MAX_CENTROIDS`` rows at most.
    sample = nodes.withColumn("dim", F.size("vec")).join(F.broadcast(sizes), ["label", "dim"]).where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < wanted * 1_000_003)
    found = sample.select("label", "dim", "k", "node", "vec").groupBy("label", "dim").applyInPandas(
        lambda pdf: pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "center": list(spherical_kmeans(_unit_rows(pdf.sort_values("node")["vec"]), int(pdf["k"].iloc[0])))}),
        "label string, dim int, center array<double>",
    ).toPandas()
    return {key: np.array(part["center"].tolist()) for key, part in found.groupby(["label", "dim"])}


def _nearest(vecs, centers: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(_unit_rows(vecs) @ centers.T), axis=1, kind="stable")[:, :overlap]


def _second_shards(nodes: DataFrame, large: DataFrame, overlap: int) -> DataFrame:
    """``(node, home, shards)`` of nodes with large shards clustered by centroids of their own.

    Nodes meet the centroids of a shard in groups of some ``ASSIGN_ROWS``; those
    of whom it is the home join ``overlap`` of its parts, others one.
    """
    placed = nodes.select("node", "label", "home", "vec", F.explode("shards").alias("shard"), F.size("vec").alias("dim"))
    inside = placed.join(F.broadcast(large), ["label", "dim", "shard"])
    wanted = F.col("k") * SAMPLE_PER_CENTROID / F.col("n")
    sample = inside.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_003)) < wanted * 1_000_003)
    centers = sample.groupBy("label", "dim", "shard").applyInPandas(
        lambda pdf: pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "deals": pdf["deals"].iloc[0], "center": list(spherical_kmeans(_unit_rows(pdf.sort_values("node")["vec"]), int(pdf["k"].iloc[0])))}),
        "label string, dim int, shard long, deals long, center array<double>",
    )
    key = ["label", "dim", "shard", "deal"]
    dealt = inside.withColumn("deal", F.pmod(F.xxhash64("node", F.lit(5)), F.col("deals"))).select(*key, "node", "home", "vec")
    centers = centers.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))

    def assign(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        shard = int((own if len(own) else known)["shard"].iloc[0])
        if not len(own) or not len(known):
            return pd.DataFrame({"node": own["node"], "at_home": own["home"] == shard, "parts": [[shard << SECOND_BITS]] * len(own)})
        # Sorted, as the order of arrival is not fixed.
        centers = _unit_rows(sorted(known["center"].map(list)))
        near, at_home = _nearest(own["vec"], centers, overlap), (own["home"] == shard).to_numpy()
        parts = [[(shard << SECOND_BITS) + int(c) for c in row[: overlap if h else 1]] for row, h in zip(near, at_home, strict=True)]
        return pd.DataFrame({"node": own["node"], "at_home": at_home, "parts": parts})

    refined = dealt.groupBy(*key).cogroup(centers.groupBy(*key)).applyInPandas(assign, "node long, at_home boolean, parts array<long>")
    others = placed.join(F.broadcast(large), ["label", "dim", "shard"], "left_anti")
    others = others.select("node", (F.col("home") == F.col("shard")).alias("at_home"), F.array(F.shiftleft("shard", SECOND_BITS)).alias("parts"))
    return refined.union(others).groupBy("node").agg(F.max(F.when(F.col("at_home"), F.element_at("parts", 1))).alias("home"), F.flatten(F.collect_list("parts")).alias("shards"))


def _memberships(nodes: DataFrame, centroids: dict, overlap: int) -> DataFrame:
    """A row for each node and unit."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vecs = batch.column("label").to_pylist(), batch.column("vec").to_pylist()
            shards: list = [[0]] * len(labels)
            groups: dict = {}
            for i, (label, vec) in enumerate(zip(labels, vecs, strict=True)):
                groups.setdefault((label, len(vec)), []).append(i)
            for key, at in groups.items():
                if key in centroids:
                    for i, row in zip(at, _nearest([vecs[i] for i in at], centroids[key], overlap).tolist(), strict=True):
                        shards[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[0] for s in shards], pa.int64()), pa.array(shards, pa.list_(pa.int64()))], [*batch.schema.names, "home", "shards"])

    own = nodes.select("node", "label", "vec", "copies")
    named = materialize(own.mapInArrow(assign, "node long, label string, vec array<double>, copies long, home long, shards array<long>"), "homes")
    # Only shards around centroids can be large: ``MAX_CENTROIDS`` rows at most.
    sizes = named.select("label", F.size("vec").alias("dim"), F.explode("shards").alias("shard")).groupBy("label", "dim", "shard").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > MAX_SHARD).withColumns({"k": F.least(F.ceil(F.col("n") / SHARD_NODES), F.lit(MAX_CENTROIDS)), "deals": F.ceil(F.col("n") / ASSIGN_ROWS)}), "large-shards")
    if not large.isEmpty():
        named = materialize(own.join(_second_shards(named, large, overlap), "node"), "second-homes")
    placed = named.withColumn("shard", F.explode("shards")).withColumn("dim", F.size("vec"))
    cuts = placed.groupBy("label", "dim", "shard").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SHARD).select("label", "dim", "shard", F.ceil(F.col("n") / (MAX_SHARD / 2)).cast("int").alias("cut"))
    placed = placed.join(cuts, ["label", "dim", "shard"], "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cut")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least(F.col("slice"), j).alias("slice_a"), F.greatest(F.col("slice"), j).alias("slice_b")))
    return placed.withColumn("unit", F.explode(units)).select("label", "dim", "shard", "unit.slice_a", "unit.slice_b", "slice", "node", "copies", "home", "shards", "vec")


UNIT = ["label", "dim", "shard", "slice_a", "slice_b"]


def graph_links(nodes: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """``(node, links, root)``, one row or more for each node: links to count, and tree edges."""
    members = materialize(_memberships(nodes, _centroids(nodes), overlap), "members")
    lists = members.groupBy(*UNIT).applyInPandas(_build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = members.join(united, "node").groupBy(*UNIT).applyInPandas(_search(threshold), "node long, links long, root long")
    return materialize(found, "graph-links")


def audit_recall(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> float:
    """Links found over links that exist, for a bounded sample of nodes compared with all nodes."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(AUDIT_QUERIES).select("node", "label", "vec").collect()
    by: dict = {}
    for r in sample:
        by.setdefault((r.label, len(r.vec)), []).append((r.node, r.vec))
    queries = {k: (np.array([v[0] for v in q]), _unit_rows([v[1] for v in q])) for k, q in by.items()}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, part in pdf.groupby(["label", pdf["vec"].map(len)]):
                if key in queries:
                    ids, q = queries[key]
                    near = (q @ _unit_rows(part["vec"]).T >= threshold) & (ids[:, None] != part["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": ids, "links": (near * part["copies"].to_numpy()[None, :]).sum(axis=1)})

    if not queries:
        return 1.0
    true = nodes.select("node", "label", "vec", "copies").mapInPandas(count, "node long, links long").agg(F.sum("links")).first()[0] or 0
    got = links.where(F.col("node").isin([r.node for r in sample])).agg(F.sum("links")).first()[0] or 0
    return got / true if true else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component_id, kept, audited_recall)`` for every row."""
    spark = vectors.sparkSession
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col)
    nodes = materialize(nodes, "nodes")
    overlap, recall = OVERLAP, 0.0
    while recall < MIN_RECALL:
        if overlap > MAX_OVERLAP:
            raise RuntimeError(f"the graph finds {recall:.3f} of the links; {MIN_RECALL} are asked for")
        links = graph_links(nodes, threshold, overlap)
        recall = audit_recall(nodes, links, threshold)
        overlap *= 2
    classes = connected_components(spark, links.select("node", "root"), nodes.select("node", F.col("node_id").alias("rank")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies").join(counts, "node", "left").join(classes, "node")
    known = known.select("node", F.struct((F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root_rank").alias("component_id")).alias("m"), F.col("copies").alias("n"))
    # Copies of one vector, however many, are looked up and not gathered.
    linked = split_join(rows.where("node is not null"), known, "node", hub_limit(rows.count()))
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.select("id", F.col("m.n_links").cast("long").alias("n_links"), F.col("m.component_id").alias("component_id")).union(alone)
    component = F.coalesce("component_id", "id")
    return every.select("id", "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))
