"""Benchmark decontamination by spaced-seed hashing.

A seed looks at five of the tokens in a short window and ignores the others, so
substituted words there do not break a hit. ``MASKS`` together meet every
alignment of 15 tokens of which at most three are substituted. The hashes of a
block of benchmark items, bounded by ``BLOCK_TOKENS``, are broadcast and joined
with the hashes of every position of every training text inside the scan of the
documents: no text is shuffled, and a passage that many documents share is no
hot key. Larger benchmarks take one scan a block. Hits collapse to alignments of
an item with a text, in blocks of bounded size, however often words repeat. An
alignment counts when at least ``SIMILARITY`` of the tokens agree over the whole
item, or over a stretch of ``MIN_TOKENS`` or more. An item of fewer tokens than a
seed counts when a whole line of a text is equal to it.

Tokens are lower-cased runs of letters, digits and non-ASCII characters.

Defined results: null and empty texts and items hit nothing; equal items are
each reported; repeated documents are each reported; of several alignments of an
item with a text the one with most agreeing tokens is reported, of those the
first; an empty table on either side gives no hits; texts of any length are
searched whole; ``find_leaks`` reads no columns but those named and
``without_leaks`` keeps all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import materialize, rows_of

#: Fixed: the first two suffice for the promise above; the others help where more words differ.
MASKS = ("11111", "111011", "110111", "11010011")
SIMILARITY = 0.8
#: What a differing token costs where an agreeing one counts 1, so that a similarity of 0.8 comes to 0.
LOSS = 4
MIN_TOKENS = 12
#: Tokens of a block of items; its index takes some 100 MB.
BLOCK_TOKENS = 1_000_000
#: Hits, and tokens of alignments, that are in memory at once.
HITS, CELLS = 1 << 20, 1 << 21
_FILTER_BITS = 22

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 63, max(map(len, MASKS)), np.uint64) | np.uint64(1)


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(_LETTERS).split()


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of ``mask`` over the token ids."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n, np.uint64)
    for at, care in enumerate(mask):
        if care == "1":
            sums += ids[at : at + n] * _FACTORS[at]
    return sums ^ (sums >> np.uint64(31))


class BenchmarkIndex:
    """Seed hashes of a block of items; what tasks receive."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(i, tokens(t)) for i, t in items]
        self.item_ids = [i for i, _ in words]
        names = sorted({w for _, ws in words for w in ws})
        # Unknown words of documents are zero; no item has that id.
        spread = np.random.default_rng(7).integers(1, 1 << 63, len(names), np.uint64)
        self.vocabulary = dict(zip(names, spread.tolist(), strict=True))
        self.items = [np.array([self.vocabulary[w] for w in ws], np.uint64) for _, ws in words]
        least = min(map(len, MASKS))
        self.short: dict[tuple, list[int]] = {}
        for i, (_, ws) in enumerate(words):
            if 0 < len(ws) < least:
                self.short.setdefault(tuple(ws), []).append(i)
        self.seeds = []
        for mask in MASKS:
            found = [seed_hashes(ids, mask) for ids in self.items]
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
            place = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]) if found else np.zeros(0, np.int32)
            # The hash one place before in the same item: a hit that continues one before it adds no alignment.
            before = np.r_[np.zeros(1, np.uint64), hashes[:-1]][: len(hashes)]
            before[place == 0] = 0
            order = np.lexsort((before == hashes, hashes))
            self.seeds.append((hashes[order], owner[order], place[order], before[order]))

    def _passes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each mask, which leading bits of a hash occur, and how many entries of each hash do not follow their own; made in the worker."""
        if not hasattr(self, "_made"):
            self._made = []
            for hashes, _, _, before in self.seeds:
                bits = np.zeros(1 << _FILTER_BITS, bool)
                bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
                self._made.append((bits, np.r_[0, np.cumsum(before != hashes)]))
        return self._made

    def _alignments(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different items, texts, and positions in a text of the item's first token, that share a seed."""
        shift = max(map(len, self.items))
        span = int((ends - starts).max()) + shift + 1
        found = np.zeros(0, np.int64)
        for (hashes, owner, place, before), mask, (passes, leading) in zip(self.seeds, MASKS, self._passes(), strict=True):
            own = seed_hashes(ids, mask)
            at = np.flatnonzero(passes[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            text = np.searchsorted(ends, at, "right")
            whole = at + len(mask) <= ends[text]
            at, text = at[whole], text[whole]
            lo, hi = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            last = np.where(at == starts[text], np.uint64(0), own[at - 1])
            # In a run of one word only the entries that begin such a run add alignments; they come first.
            hi = np.where(last == own[at], lo + leading[hi] - leading[lo], hi)
            some = hi > lo
            at, text, lo, last, count = at[some], text[some], lo[some], last[some], (hi - lo)[some]
            upto, cut = np.cumsum(count), 0
            while cut < len(at):
                to = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + HITS, "right")))
                n = count[cut:to]
                entry = np.repeat(lo[cut:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                new = (before[entry] != np.repeat(last[cut:to], n)) | (before[entry] == 0)
                entry = entry[new]
                own_text = np.repeat(text[cut:to], n)[new]
                place_in_text = np.repeat(at[cut:to], n)[new] - starts[own_text] - place[entry]
                found = np.union1d(found, (owner[entry].astype(np.int64) * len(ends) + own_text) * span + place_in_text + shift)
                cut = to
        item, text = np.divmod(found // span, len(ends))
        return item, text, found % span - shift

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, first token, tokens, agreeing)``: the best leak of each text and item."""
        known = self.vocabulary.get
        words = [[known(w, 0) for w in tokens(t)] for t in texts]
        ends = np.cumsum([len(w) for w in words])
        ids = np.array([i for w in words for i in w], np.uint64)
        starts = ends - [len(w) for w in words]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(ids) and self.items:
            items, of, places = self._alignments(ids, starts, ends)
            edges = np.flatnonzero(np.diff(items)) + 1
            for lo, hi in zip(np.r_[0, edges].tolist(), np.r_[edges, len(items)].tolist(), strict=True):
                if lo < hi:
                    self._verify(ids, int(items[lo]), of[lo:hi], places[lo:hi], starts, ends, best)
        found = [(text, item, *leak) for (text, item), leak in best.items()]
        if self.short:
            for text, t in enumerate(texts):
                at = 0
                for line in t.split("\n"):
                    line = tuple(tokens(line))
                    for item in self.short.get(line, ()):
                        found.append((text, item, at, len(line), len(line)))
                    at += len(line)
        return found

    def _verify(self, ids: np.ndarray, item: int, texts: np.ndarray, firsts: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: dict) -> None:
        """Notes the best leak of an item in each text, of the alignments given."""
        own = self.items[item]
        step, places = max(1, CELLS // len(own)), np.arange(len(own))
        for cut in range(0, len(texts), step):
            of, some = texts[cut : cut + step], firsts[cut : cut + step]
            position = (starts[of] + some)[:, None] + places[None, :]
            inside = (position >= starts[of, None]) & (position < ends[of, None])
            agree = inside & (ids[np.clip(position, 0, len(ids) - 1)] == own[None, :])
            same = agree.sum(axis=1)
            full = inside.all(axis=1) & (same >= SIMILARITY * len(own))
            # Else the longest stretch of the largest surplus of agreement over the similarity asked for, in whole numbers.
            possible = np.flatnonzero(~full & (same >= SIMILARITY * MIN_TOKENS))
            surplus = np.zeros((len(possible), len(own) + 1), np.int32)
            np.cumsum(np.where(agree[possible], 1, -LOSS), axis=1, out=surplus[:, 1:])
            to = len(own) - (surplus - np.minimum.accumulate(surplus, axis=1))[:, ::-1].argmax(axis=1)
            for k in np.flatnonzero(full).tolist():
                self._note(best, int(of[k]), item, int(some[k]), len(own), int(same[k]))
            for k, end, line in zip(possible.tolist(), to.tolist(), surplus, strict=True):
                begin = int(line[: end + 1].argmin())
                if end - begin >= MIN_TOKENS:
                    self._note(best, int(of[k]), item, int(some[k]) + begin, end - begin, int(agree[k, begin:end].sum()))

    @staticmethod
    def _note(best: dict, text: int, item: int, first: int, n: int, same: int) -> None:
        _, _, known = best.get((text, item), (0, 0, 0))
        if same > known:
            best[text, item] = (first, n, same)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[BenchmarkIndex]:
    """Indexes of blocks of items, each bounded in tokens."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(tokens(r.t))
        if block and size + n > BLOCK_TOKENS:
            yield BenchmarkIndex(block)
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield BenchmarkIndex(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, first_token, n_tokens, n_agreeing, similarity)``: the best leak of each row of ``docs`` and item."""
    spark = docs.sparkSession
    schema = "id long, item long, first_token long, n_tokens long, n_agreeing long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def searched(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part, texts in rows_of(batch, "text"):
                    own = part.column("id").to_pylist()
                    out = [(own[t], index.item_ids[i], *leak) for t, i, *leak in index.search(texts)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], ["id", "item", "first_token", "n_tokens", "n_agreeing"])

        return search

    found, blocks = None, _blocks(benchmark, item_col, item_text_col)
    index = next(blocks, None)
    while index is not None:
        shared, after = spark.sparkContext.broadcast(index), next(blocks, None)
        part = rows.mapInArrow(searched(shared), schema)
        if found is not None or after is not None:
            # One block is in memory at a time: its leaks are written before the next is sent.
            part = materialize(part, "leaks")
            shared.unpersist()
        found = part if found is None else found.union(part)
        index = after
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumn("similarity", F.col("n_agreeing") / F.col("n_tokens"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""

    def clean(shared):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in rows_of(batch, text_col):
                    leaking = {t for t, *_ in shared.value.search(texts)}
                    yield part.filter(pa.array([i not in leaking for i in range(len(texts))], pa.bool_()))

        return keep

    for index in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
