"""SimHash near-duplicates by deletion-variant signatures.

``fingerprints`` gives every text a 64-bit SimHash of its word shingles.
``linked_fingerprints`` finds all pairs of different fingerprints at most four
bits apart: the 64 bits are cut into three segments, so that four differing
bits leave at least one segment with at most one of them. Every fingerprint is
indexed under each segment with each one of its bits left out (64 signatures);
an equality join on the signature meets every such pair, and the join condition
verifies the whole distance and lets just one of the shared signatures speak.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows keep one output row each; texts of any length are hashed
whole; an empty table gives an empty result; columns other than the id and the
text are ignored by the digest, and ``one_of_each`` keeps all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.components import connected_components, hub_limit, split_join
from scoreloom.llm.shared import fresh, materialize, rows_of

BITS = 64
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Distinct fingerprints from which signatures take in a piece of the other bits; below, few fingerprints share one by chance.
REFINE_FROM = 1 << 22
#: The most differing bits that three segments with a wildcard each are sure to find.
REACH = 2 * len(SEGMENTS) - 1

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``width`` words joined by spaces (fewer words: of all of them)."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def simhash(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 64):
        part = np.array(hashes[at : at + 255 * 64], np.uint64)
        # One byte a bit, summed eight at a time: 255 rows cannot overflow a byte.
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in rows_of(batch, "text"):
            prints = np.array([simhash(shingle_hashes(t, width)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, width), "id long, fp long")


def _low_bit(x):
    return x.bitwiseAND(-x)


def _pieces(mask: int, n: int) -> list[int]:
    """The bits outside of ``mask``, in ``n`` parts of like size."""
    others = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in others[i * len(others) // n : (i + 1) * len(others) // n]) for i in range(n)]


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, refined: bool | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of different values of ``prints.fp`` (distinct) at most ``max_bits`` apart, each once.

    From ``REFINE_FROM`` fingerprints on, a signature takes in a piece of the bits
    outside of its segment. Of ``max_bits + 1`` pieces one is equal in both, so no
    pair is lost: as many times the rows, some 2⁷ to 2⁸ times fewer candidates each.
    """
    if max_bits >= 2 * len(SEGMENTS):
        raise ValueError(f"{len(SEGMENTS)} segments with one wildcard find up to {2 * len(SEGMENTS) - 1} bits")
    if refined is None:
        refined = prints.count() >= REFINE_FROM
    signed = lambda v: F.lit(v - (1 << 64) if v >= 1 << 63 else v)
    masks = [((1 << w) - 1) << at for at, w in SEGMENTS]
    pieces = [_pieces(m, max_bits + 1) if refined else [0] for m in masks]
    fields = [(s, 1 << bit, masks[s] & ~(1 << bit), p) for s, (at, w) in enumerate(SEGMENTS) for bit in range(at, at + w) for p in pieces[s]]
    signatures = F.array(*(F.struct(signed(wild).alias("wild"), signed(piece).alias("piece"), signed(kept | piece).alias("kept")) for _, wild, kept, piece in fields))
    index = prints.select("fp", F.explode(signatures).alias("s")).select("fp", F.col("s.wild").alias("wild"), F.col("s.piece").alias("piece"), F.col("fp").bitwiseAND(F.col("s.kept")).alias("rest"))
    a, b = index.alias("a"), index.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # The signature that speaks: of the first segment with at most one difference, that bit, or the lowest bit if there is none; and the first equal piece.
    speaks, first_piece = F.lit(0).cast("long"), F.lit(0).cast("long")
    for (at, _), mask, own_pieces in reversed(list(zip(SEGMENTS, masks, pieces, strict=True))):
        own = diff.bitwiseAND(signed(mask))
        equal = signed(own_pieces[-1])
        for piece in own_pieces[-2::-1]:
            equal = F.when(diff.bitwiseAND(signed(piece)) == 0, signed(piece)).otherwise(equal)
        speaks = F.when(F.bit_count(own) <= 1, F.when(own == 0, signed(1 << at)).otherwise(own)).otherwise(speaks)
        first_piece = F.when(F.bit_count(own) <= 1, equal).otherwise(first_piece)
    same = (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest"))
    found = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= max_bits) & (speaks == F.col("a.wild"))
    if refined:
        same, found = same & (F.col("a.piece") == F.col("b.piece")), found & (first_piece == F.col("a.piece"))
    else:
        a, b = (x.drop("piece") for x in (a, b))
    # Sizes are judged before signatures are spelled out: a broadcast of them would not be small.
    return a.join(b.hint("merge"), same & found).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def fingerprint_classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, root, first_id, n)`` for each value of ``prints(id, fp)``: its class, the smallest id in it, and the rows of the value.

    Equal fingerprints are one node and only different ones are joined, so a
    group of copies of any size costs one row.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rank"), F.count("*").alias("n")), "simhash-nodes")
    links = linked_fingerprints(nodes.select("fp"), max_bits)
    classes = connected_components(prints.sparkSession, links, nodes.select(F.col("fp").alias("node"), "rank"))
    return classes.select(F.col("node").alias("fp"), "root", F.col("root_rank").alias("first_id")).join(nodes.select("fp", "n"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` and ``component_id``, the smallest id reachable over links."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = fingerprint_classes(prints, max_bits).select("fp", F.col("first_id").alias("m"), "n")
    # Texts that many rows share, as the empty one, are looked up and not gathered.
    return split_join(prints, classes, "fp", hub_limit(prints.count())).select("id", "fp", F.coalesce("m", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = REACH) -> DataFrame:
    """One row of each group of ``docs`` stays, that of the smallest id, with all its columns."""
    fp = fresh("fp", docs.columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rows_of(batch, text_col):
                prints = np.array([simhash(shingle_hashes(t.encode(), width)) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints.view(np.int64))], [*part.schema.names, fp])

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    rows = materialize(docs.mapInArrow(add, schema), "simhash-rows")
    prints = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    return first_of_classes(rows, fingerprint_classes(prints, max_bits).withColumnRenamed("fp", fp), docs.columns, id_col, fp)


def first_of_classes(rows: DataFrame, classes: DataFrame, columns: list[str], id_col: str, key: str) -> DataFrame:
    """One row, that of the smallest id, for each ``root`` of ``classes``, which has a row for each value of ``rows[key]``."""
    kept_id, kept_key, copies = (fresh(n, rows.columns) for n in ("kept_id", "kept_key", "copies"))
    keys = rows.select(F.col(id_col).alias("id"), F.col(key).alias("key"))
    first = keys.join(classes.select(F.col(key).alias("key"), "root"), "key").groupBy("root").agg(F.min(F.struct("id", "key")).alias("kept"))
    counts = keys.groupBy("id", "key").agg(F.count("*").alias("copies"))
    kept = first.join(counts, [F.col("kept.id").eqNullSafe(F.col("id")), F.col("kept.key") == F.col("key")])
    kept = materialize(kept.select(F.col("id").alias(kept_id), F.col("key").alias(kept_key), F.col("copies").alias(copies)), "kept-rows")
    found = rows.join(kept, [F.col(key) == F.col(kept_key), F.col(id_col).eqNullSafe(F.col(kept_id))])
    # Rows repeated with id and text, if any, are the only ones that are dealt out to leave one.
    again = kept.where(F.col(copies) > 1).limit(1).count()
    single = found.where(F.col(copies) == 1).select(*columns) if again else found.select(*columns)
    return single.union(found.where(F.col(copies) > 1).dropDuplicates([kept_id, kept_key]).select(*columns)) if again else single
