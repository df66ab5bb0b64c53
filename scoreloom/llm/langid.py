"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary of its own texts. A
text is compressed with every dictionary; the smallest result names the
language. A text whose two smallest results are too close is marked as rejected.

Fitting takes a bounded sample, ``SAMPLE_TEXTS`` texts and ``DICTIONARY_BYTES``
bytes a language, of the rows that are not held out; of a text of over
``PIECE_CHARS`` characters one piece of that size, from a place that a hash of its
id picks. Rows are picked by such a hash too, so the sample does not depend on the
layout of the table.

Defined results: ``und`` and score 0 for texts that are null or have no letter;
ties of size go to the language with the most learned rows, then to the first by
name, and are rejected; repeated rows get equal results; with nothing to learn
from every text is ``und``; an empty table gives an empty result; whole texts of
any length are compressed; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.shared import held_out, rows_of

SAMPLE_TEXTS = 400
DICTIONARY_BYTES = 96 << 10
PIECE_CHARS = 6 << 10
#: Short matches count in texts of a few sentences.
COMPRESSION = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 4, "min_match": 5, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY}
#: Rejected when the second smallest is less than this share above the smallest.
MARGIN = 0.02
UNDETERMINED = "und"

#: ASCII that is no letter becomes a space.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def prepared(text: str) -> bytes:
    """Lower case, and runs of anything but letters as one space."""
    return b" ".join(text.lower().encode("utf-8").translate(_PLAIN).split())


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the rows that are not held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    order = F.xxhash64(F.col(id_col), F.lit(5))
    # One count a language, as many as there will be dictionaries.
    sizes = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    # A first cut by hash, in the scan, keeps about four times the sample: little text is shuffled and sorted.
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_003, 4 * SAMPLE_TEXTS * 1_000_003 // n + 1))))
    share = F.pmod(order, F.lit(1_000_003)) < F.element_at(limits, F.col(lang_col))
    text, spare = F.col(text_col).cast("string"), F.length(text_col) - PIECE_CHARS
    piece = F.when(spare > 0, F.substring(text, (1 + F.pmod(order, spare)).cast("int"), F.lit(PIECE_CHARS))).otherwise(text)
    drawn = rows.where(share).select(F.col(id_col), piece.alias("text"), F.col(lang_col).alias("lang"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, F.col(id_col), F.xxhash64("text"))))
    chosen: dict[str, list] = {}
    for r in ranked.where(F.col("k") <= SAMPLE_TEXTS).select("lang", "k", "text").toLocalIterator():
        chosen.setdefault((-sizes[r.lang], r.lang), []).append((r.k, prepared(r.text)))
    found = {}
    for (_, lang), texts in sorted(chosen.items()):
        parts, size = [], 0
        for _, text in sorted(texts):
            if size + len(text) <= DICTIONARY_BYTES:
                parts.append(text)
                size += len(text) + 1
        if size > 8:
            found[lang] = b" ".join(parts)
    return found


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.compressors = []
        for lang in self.languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=zstandard.ZstdCompressionParameters(**COMPRESSION, write_content_size=False)))

    def classify(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        data = prepared(text)
        sizes = [len(c.compress(data)) for c in self.compressors]
        least = min(sizes)
        second = min((s for i, s in enumerate(sizes) if i != sizes.index(least)), default=2 * least)
        score = 1 / sum(2.0 ** -min(60, (s - least) / 4) for s in sizes)
        return self.languages[sizes.index(least)], score if math.isfinite(score) else 0.0, (second - least) < MARGIN * least


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, rejected)`` for every row."""
    kept: dict = {}

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in kept:
            kept["model"] = CompressionClassifier(dictionaries)
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                lang, score, rejected = zip(*map(kept["model"].classify, texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(classify, "id long, lang_pred string, score double, rejected boolean")
