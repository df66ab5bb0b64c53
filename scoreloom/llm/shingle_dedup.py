"""Near-duplicates by the Jaccard similarity of word shingles, 0.8 or more, without misses.

Texts with the same set of shingles are one node. Candidates come from SimHash
deletion variants first; every pair is verified on the shingles of the texts.
What SimHash misses is found by prefix filtering: of n shingles in one order that
all texts share, the first ``n - ceil(0.8 n) + 1`` of two similar texts have one in
common. Each text is first compared with one text of each shingle, which connects
most of a large group; then all that are not connected meet. The order puts shingles that are frequent in a sample last; it decides
how many candidates there are, never which pairs are found. Pairs that are already
connected are not compared again, and sketches of the sets, which never rule out a
similar pair, are held against each other inside the join: what leaves it are few
pairs but the similar ones, however many texts share a shingle. A pair speaks at the
first shingle that it shares. All before that one are in one text alone, so it stands
early in both texts if they are similar; and where some of the open shingles just
before it are the same in both, it is not the first: the pair met there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scoreloom.llm import simhash
from scoreloom.llm.components import connected_components
from scoreloom.llm.shared import fresh, materialize, rows_of, small_batches

WIDTH = 5
#: Texts whose shingles are counted for the order, and the most frequent ones that it puts last.
SAMPLE, FREQUENT = 50_000, 200_000
#: Prefix rows of one Arrow batch.
ROWS = 200_000
#: Ranges of hashes that are counted together, a power of two.
RANGES = 1024
#: Longs of a sketch.
SKETCH = 16
#: Shingles before a shared one that are looked through for an earlier shared one.
BEFORE = 8


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.array(simhash.shingle_hashes((text or "").encode(), width), np.uint64))


def described(text: str, width: int) -> tuple[int, int, int, bytes, list[int]]:
    """Fingerprint, hash of the set of shingles, its size, histogram and sketch. Hashes of one text only are held at a time."""
    hashes = simhash.shingle_hashes(text.encode(), width)
    found = np.unique(np.array(hashes, np.uint64))
    return simhash.simhash(hashes), xxhash.xxh64_intdigest(found.tobytes()), len(found), histogram(found), sketch(found)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def histogram(shingles: np.ndarray) -> bytes:
    """How many hashes end in each byte, 255 for that and more."""
    return np.minimum(np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def sketch(shingles: np.ndarray) -> list[int]:
    """A bit for each of ``64 * SKETCH`` remainders that some shingle has, as longs."""
    bits = np.zeros(64 * SKETCH, bool)
    bits[(shingles >> np.uint64(8)).astype(np.int64) % (64 * SKETCH)] = True
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def may_be_close(n_a: Column, sketch_a: Column, n_b: Column, sketch_b: Column) -> Column:
    """False where sizes or sketches rule out a similarity of 0.8: then more than a ninth of both sets, added, are in one alone.

    A bit that only one sketch has stands for a shingle, or more, that only one text has.
    """
    apart = sum(F.bit_count(F.get(sketch_a, F.lit(i)).bitwiseXOR(F.get(sketch_b, F.lit(i)))) for i in range(SKETCH))
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * apart <= n_a + n_b)


def may_be_first(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """False where a shingle at these places cannot be the first one that two similar sets of these sizes share: too few follow."""
    return 9 * F.least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """False where the histograms (rows of ``a`` and ``b``) leave too few shingles in common; ``sizes`` of both sets added."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return (9 * most >= 4 * sizes) | ((a == 255) & (b == 255)).any(axis=1)


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one; ``frequent`` is sorted by hash, ``counts`` belongs to it."""
    n = len(shingles)
    size = n - (4 * n + 4) // 5 + 1 if n else 0
    if not n or not len(frequent):
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    count = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.argsort(count, kind="stable")][:size]


def prefix_rows(prefixes: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
    """A row for each shingle of each prefix, with its place in the text and the number of the text's shingles."""
    lengths = [len(x) for x in prefixes]
    at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
    columns = [np.concatenate(prefixes).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), at, np.repeat(np.array(sizes, np.int32), lengths)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "node", "at", "size"])


def packed_ranges(hashes: np.ndarray) -> pa.RecordBatch:
    """A row for each range of hashes that has some: the different ones in order, and how often each is there."""
    found, n = np.unique(hashes, return_counts=True)
    parts, starts = np.unique(found // np.uint64((1 << 64) // RANGES), return_index=True)
    cuts = list(pairwise([*starts.tolist(), len(found)]))
    columns = [pa.array(parts.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (found, n.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, ["part", "hashes", "counts"])


def repeated(rows: pa.Table) -> pa.Table:
    """The hashes of one range that are there twice or more, and how often."""
    hashes, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("counts", np.int64)))
    order = np.argsort(hashes)
    found, starts = np.unique(hashes[order], return_index=True)
    n = np.add.reduceat(counts[order], starts)
    return pa.table({"h": found.view(np.int64)[n > 1], "n": n[n > 1]})


def frequent_shingles(rows: DataFrame, node: str, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that repeat in a sample of different texts, and how often.

    Nearly all hashes are met once, so a row for each would fill a task's memory: they go packed, by ranges.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in rows_of(batch, text):
                yield packed_ranges(np.concatenate([shingle_set(t, width) for t in texts]))

    total = rows.count()
    part = F.pmod(F.xxhash64(F.col(node)), F.lit(1_000_003)) < 1_000_003 * min(1.0, SAMPLE / max(1, total))
    packed = rows.where(part).select(text).mapInArrow(emit, "part int, hashes binary, counts binary")
    counted = packed.groupBy("part").applyInArrow(repeated, "h long, n long")
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes, counts = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def shared_prefixes(rows: DataFrame, node: str, text: str, width: int) -> DataFrame:
    """``(h, node, at)`` of the prefix shingles that two nodes or more have; ``at`` is the place in the order, from 0.

    A shingle so late in a text that it could not be the first that is shared even with the smallest text that has it is left out.
    """
    frequent, counts = frequent_shingles(rows, node, text, width)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part, texts in rows_of(batch, text):
                hashes, nodes, sizes, held = [], [], [], 0
                for k, t in zip(part.column(node).to_pylist(), texts, strict=True):
                    if k in seen:
                        continue
                    seen.add(k)
                    shingles = shingle_set(t, width)
                    found = prefix(shingles, frequent, counts)
                    hashes.append(found)
                    nodes.append(k)
                    sizes.append(len(shingles))
                    held += len(found)
                    if held >= ROWS:
                        yield prefix_rows(hashes, nodes, sizes)
                        hashes, nodes, sizes, held = [], [], [], 0
                if held:
                    yield prefix_rows(hashes, nodes, sizes)

    index = rows.select(F.col(node), F.col(text)).mapInArrow(emit, "h long, node long, at int, size int").repartition("h").dropDuplicates(["h", "node"])
    block = Window.partitionBy("h")
    counted = index.withColumn("n", F.count("*").over(block)).withColumn("least", F.min("size").over(block))
    met = counted.where("n > 1").where(9 * (F.col("size") - F.col("at")) >= 4 * (F.col("size") + F.col("least")))
    return materialize(met.select("h", "node", "at"), "prefixes")


def verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, node: str, text: str, width: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose texts are similar. Sizes and histograms rule pairs out before texts are read."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("hist_a", "hist_b"))
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(a, b, batch.column("sizes").to_numpy())))

    a, b = (prints.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("hist").alias(f"hist_{x}")) for x in "ab")
    different = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    alike = different.join(a, "a").join(b, "b").where(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    alike = alike.select("a", "b", "hist_a", "hist_b", (F.col("n_a") + F.col("n_b")).alias("sizes"))
    pairs = materialize(alike.mapInArrow(possible, "a long, b long"), "candidates")
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    texts = rows.select(F.col(node).alias("node"), F.col(text).alias("text")).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts = materialize(texts, "candidate-texts")
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in rows_of(batch, "text_a"):
                of = lru_cache(2_000)(lambda t: shingle_set(t, width))  # a slice bounds what it holds
                good = [similar(of(x), of(y)) for x, y in zip(left, part.column("text_b").to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "similar")


def candidates_by_simhash(prints: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are within the reach of three segments; one node speaks for each fingerprint."""
    speakers = materialize(prints.groupBy("fp").agg(F.min("node").alias("node")), "speakers")
    links = simhash.linked_fingerprints(speakers.select("fp"), simhash.REACH)
    a, b = (speakers.withColumnsRenamed({"fp": x, "node": f"node_{x}"}) for x in "ab")
    near = links.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = prints.join(speakers.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    return near.union(same)


def candidates_by_star(blocks: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs of a node and the smallest node of one of its prefix shingles, not connected yet: no more than prefix rows."""
    centers = blocks.groupBy("h").agg(F.min("node").alias("b"))
    pairs = blocks.join(centers, "h").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    known = materialize(classes.select("node", "root").join(prints.select("node", "n", "sketch"), "node"), "known-nodes")
    a, b = (known.select(*(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "sketch")), F.col("node").alias(x)) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").where("root_a <> root_b")
    return met.where(may_be_close(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"))).select("a", "b")


def candidates_by_prefix(blocks: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs of nodes that share a prefix shingle, are not connected yet and that sizes, places and sketches do not rule out.

    All shingles that such a pair shares are open, with two roots or more. Where some of the ``BEFORE`` open ones that
    stand before a shared one are the same in both, the pair has met.
    """
    placed = materialize(blocks.join(classes.select("node", "root"), "node"), "placed")
    main = placed.groupBy("h", "root").agg(F.count("*").alias("rows")).groupBy("h").agg(F.max(F.struct("rows", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    main = materialize(main.select("h", F.col("most.root").alias("main")), "main-roots")
    last = Window.partitionBy("node").orderBy("at").rowsBetween(-BEFORE, -1)
    open_ = placed.join(main, "h").withColumn("before", F.collect_list("h").over(last))
    open_ = materialize(open_.join(prints.select("node", "n", "sketch"), "node"), "open-shingles")
    fields = ("node", "at", "before", "root", "n", "sketch")
    a, b = (x.select("h", *(F.col(c).alias(f"{c}_{side}") for c in fields)) for x, side in ((open_.where("root <> main"), "a"), (open_, "b")))
    met = a.join(b, "h").where("root_a <> root_b").where(may_be_first(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
    met = met.where(~F.arrays_overlap("before_a", "before_b"))
    close = met.where(may_be_close(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b")))
    return close.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def known_links(classes: DataFrame) -> DataFrame:
    """A link to its root for each node of ``classes``: what stands for all links found so far."""
    return classes.where("node <> root").select("node", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group of ``docs`` stays, that of the smallest id, with all its columns."""
    with small_batches(docs.sparkSession):
        rows, classes, node = _classes_of(docs, id_col, text_col, width)
    return simhash.first_of_classes(rows, classes, docs.columns, id_col, node)


def _classes_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` with a node each, the root of each node, and the name of the node's column; all written."""
    fp, node, n, hist, bits = (fresh(c, docs.columns) for c in ("fp", "node", "n", "hist", "sketch"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, text_col):
                prints, nodes, sizes, histograms, sketches = zip(*(described(t, width) for t in texts), strict=True)
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, nodes)]
                added = [*hashes, pa.array(sizes, pa.int64()), pa.array(histograms, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, fp, node, n, hist, bits])

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(node, T.LongType()), T.StructField(n, T.LongType()), T.StructField(hist, T.BinaryType()), T.StructField(bits, T.ArrayType(T.LongType()))])
    rows = materialize(docs.mapInArrow(add, schema), "shingle-rows")
    prints = materialize(rows.groupBy(F.col(node).alias("node")).agg(F.min(fp).alias("fp"), F.min(id_col).alias("rank"), F.min(n).alias("n"), F.min(hist).alias("hist"), F.min(bits).alias("sketch")), "shingle-nodes")
    spark, nodes = docs.sparkSession, prints.select("node", "rank")
    links = verified(candidates_by_simhash(prints), prints, rows, node, text_col, width)
    classes = materialize(connected_components(spark, links, nodes), "classes")
    prefixes = shared_prefixes(rows, node, text_col, width)
    for candidates in (candidates_by_star, candidates_by_prefix):
        links = verified(candidates(prefixes, classes, prints), prints, rows, node, text_col, width)
        classes = materialize(connected_components(spark, known_links(classes).union(links), nodes), "classes")
    return rows, classes.select(F.col("node").alias(node), "root"), node
