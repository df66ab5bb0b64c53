"""Source divergence audit by chunk factorization.

Documents are cut at white space and their chunks counted, many documents to a
block. Every globally distinct chunk is tokenized once. The documents of a term's
chunks, added up, are at least those of the term, so terms below the limit by this
sum go at once, and with them nearly all chunks.

A block's posting lists are the numbers of its documents that hold a chunk, and how
often. The terms of the chunks that stay are joined to these lists, and each block
merges the lists of a term's chunks, so a document counts once however many of its
chunks hold the term. A block has one language, and a document lies in one block
only, so sums over blocks are exact. While the table of these terms is small by its
own count, it is broadcast and joined inside the blocks; otherwise the lists are
shuffled to it and back. Both ways give the same rows.

Sources of a language are compared on the terms that enough of its documents
hold: p is the smoothed share of a term in billionths, and the distance of two
sources is the sum of |p − q| over all kept terms. Terms are dealt to buckets;
a bucket adds up a matrix of sources, so no pair of sources is a row of its own
before that.

Defined results: null texts, languages and sources are empty strings; a text
without terms still makes its source occur; a chunk of any length is one row;
ties in value go by the item's bytes; repeated rows are documents of their own;
other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.shared import materialize

TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that a task cuts up at once, and cells (terms x sources) of a bucket.
BLOCK_BYTES, CELLS = 12 << 20, 1 << 18
#: Rows and bytes of text of a table that may be broadcast.
SMALL_ROWS, SMALL_BYTES = 4_000_000, 64 << 20

_POSTINGS = "block long, lang string, chunk string, sources array<string>, docs array<int>, times array<int>"
_ARROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("chunk", pa.string()), ("sources", pa.list_(pa.string())), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _posting_lists(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The distinct chunks of ``texts``, and for each the places of the texts that hold it and how often."""
    cut = pc.ascii_split_whitespace(texts)
    chunks = cut.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(cut).to_numpy())
    key = chunks.indices.to_numpy().astype(np.int64) << 32 | owner
    # What stands before the first and after the last white space may be empty.
    blank = pc.index(chunks.dictionary, "").as_py()
    pairs, times = np.unique(key[key >> 32 != blank], return_counts=True)
    first = np.flatnonzero(np.r_[True, pairs[1:] >> 32 != pairs[:-1] >> 32][: len(pairs)])
    offsets = pa.array(np.r_[first, len(pairs)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, times)]
    return chunks.dictionary.take(pa.array(pairs[first] >> 32)), *lists


def _in_blocks(docs: DataFrame, columns: tuple[str, str, str], emit, schema: str) -> DataFrame:
    """``emit(block, lang, table)`` for blocks of ``(text, source)`` of one language; a block's number is the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held, parts = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            table = pa.Table.from_batches(parts).combine_chunks()
            for lang in table["lang"].unique().to_pylist():
                yield from emit(task << 32 | serial, lang, table.filter(pc.equal(table["lang"], lang)).combine_chunks())
                serial += 1
            parts.clear()
            held = 0

        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_BYTES / max(1, batch.nbytes)))
            for low in range(0, batch.num_rows, step):
                parts.append(batch.slice(low, step))
                held += parts[-1].nbytes
                if held >= BLOCK_BYTES:
                    yield from flush()
        if parts:
            yield from flush()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(*(plain(c).alias(n) for c, n in zip(columns, ("text", "lang", "source"), strict=True))).mapInArrow(run, schema)


def chunk_counts(docs: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """``(chunk, docs)`` of each block: how many of its documents hold a chunk."""

    def emit(block: int, lang: str, own: pa.Table) -> Iterator[pa.RecordBatch]:
        chunks, at, _ = _posting_lists(own["text"].chunk(0))
        rows = pa.RecordBatch.from_arrays([chunks, pc.list_value_length(at).cast(pa.int64())], ["chunk", "docs"])
        yield from (rows.slice(low, 50_000) for low in range(0, rows.num_rows, 50_000))

    return _in_blocks(docs, columns, emit, "chunk string, docs long")


def chunk_postings(docs: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """``(block, lang, chunk, docs, times)``, and for each block a row of its documents' ``sources``."""

    def emit(block: int, lang: str, own: pa.Table) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([{"block": block, "lang": lang, "sources": own["source"].to_pylist()}], _ARROW)
        chunks, at, times = _posting_lists(own["text"].chunk(0))
        n = len(chunks)
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.repeat(lang, n), chunks, pa.nulls(n, pa.list_(pa.string())), at, times], schema=_ARROW)
        yield from (rows.slice(low, 50_000) for low in range(0, n, 50_000))

    return _in_blocks(docs, columns, emit, _POSTINGS)


def chunk_terms(chunk: Column) -> Column:
    """The terms of a chunk, each with its number of occurrences."""
    found = F.regexp_extract_all(F.translate(chunk, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.when(F.size(found) == 1, F.array(F.struct(found[0].alias("term"), F.lit(1).cast("long").alias("k")))).otherwise(
        F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.size(F.filter(found, lambda x: x == t)).cast("long").alias("k")))
    )


_COUNTS = "lang string, source string, term string, docs long, occurrences long"


def _counted(lang: str, sources: pa.Array, terms: pa.Array, tid: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Of postings (term, document, occurrences) of one block: documents, each once, and occurrences by term and source."""
    own = sources.dictionary_encode()
    codes, width = own.indices.to_numpy().astype(np.int64), len(own.dictionary)
    key = tid << 32 | at
    del tid, at
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    del order
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    pairs, times = key[first], np.add.reduceat(n, first) if len(first) else n
    del key, n, first
    cells = (pairs >> 32) * width + codes[pairs & 0xFFFFFFFF]
    cell, where, df = np.unique(cells, return_inverse=True, return_counts=True)
    # Sums inside a block are far below 2^53.
    occ = np.bincount(where, weights=times, minlength=len(cell)).astype(np.int64)
    columns = [pa.repeat(lang, len(cell)), own.dictionary.take(pa.array(cell % width)), terms.take(pa.array(cell // width)), pa.array(df.astype(np.int64)), pa.array(occ)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "occurrences"])


def _spread(lists: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists ``rows``, one after the other, and the length of each."""
    offsets, sizes = lists.offsets.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy()[rows].astype(np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return lists.values.to_numpy()[np.repeat(offsets[rows], sizes) + within], sizes


def counts_in_blocks(docs: DataFrame, columns: tuple[str, str, str], terms: pa.Table) -> DataFrame:
    """Documents and occurrences by language, source and term, summed in each block; ``terms`` (chunk, term, k) is broadcast."""
    terms = terms.sort_by("chunk").combine_chunks()
    chunks, names = (terms[c].chunk(0).dictionary_encode() if len(terms) else pa.array([], pa.string()).dictionary_encode() for c in ("chunk", "term"))
    starts = np.flatnonzero(np.r_[True, np.diff(chunks.indices.to_numpy()) != 0][: len(terms)])
    held = docs.sparkSession.sparkContext.broadcast((chunks.dictionary, np.r_[starts, len(terms)], names.dictionary, names.indices.to_numpy().astype(np.int64), terms["k"].to_numpy()))

    def emit(block: int, lang: str, own: pa.Table) -> Iterator[pa.RecordBatch]:
        known, bounds, dictionary, term, k = held.value
        found, at, times = _posting_lists(own["text"].chunk(0))
        place = pc.index_in(found, value_set=known)
        hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        place = place.take(pa.array(hit)).to_numpy().astype(np.int64)
        # A row for each term of each chunk, then one for each document of it.
        each = bounds[place + 1] - bounds[place]
        entry = np.repeat(bounds[place], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        rows = np.repeat(hit, each)
        (documents, sizes), (n, _) = _spread(at, rows), _spread(times, rows)
        rows_out = _counted(lang, own["source"].chunk(0), dictionary, np.repeat(term[entry], sizes), documents.astype(np.int64), n.astype(np.int64) * np.repeat(k[entry], sizes))
        yield from (rows_out.slice(low, 50_000) for low in range(0, rows_out.num_rows, 50_000))

    return _in_blocks(docs, columns, emit, _COUNTS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, the sources first, then the lists by term: documents and occurrences by term and source."""
    sources = lang = rest = None

    def merged(part: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole terms of one block."""
        terms = part["term"].combine_chunks().dictionary_encode()
        every = np.arange(part.num_rows)
        (at, sizes), (n, _) = (_spread(part[c].combine_chunks(), every) for c in ("docs", "times"))
        yield _counted(lang, sources, terms.dictionary, np.repeat(terms.indices.to_numpy().astype(np.int64), sizes), at.astype(np.int64), n.astype(np.int64) * np.repeat(part["k"].to_numpy(), sizes))

    def ended(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """All terms of ``table`` but the last, which may go on; that one as well at the end."""
        nonlocal sources, lang, rest
        block, term = table["block"].to_numpy(), pc.fill_null(table["term"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (term[1:] != term[:-1])])
        stop = len(block) if last else int(new[-1])
        rest = table.slice(stop)
        heads = np.flatnonzero(term[:stop] < 0)
        for low, high in zip(np.r_[0, heads].tolist(), np.r_[heads, stop].tolist(), strict=True):
            if low < stop and term[low] < 0:
                lang, sources = table["lang"][low].as_py(), table["sources"].combine_chunks().slice(low, 1).flatten()
                low += 1
            if low < high:
                yield from merged(table.slice(low, high - low))

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from ended(table if rest is None else pa.concat_tables([rest, table]), False)
    if rest is not None and rest.num_rows:
        yield from ended(rest, True)


def _is_small(df: DataFrame, *texts: str) -> bool:
    size = df.agg(F.count("*"), *(F.sum(F.octet_length(c)) for c in texts)).first()
    return size[0] <= SMALL_ROWS and sum(x or 0 for x in size[1:]) <= SMALL_BYTES


def term_counts(docs: DataFrame, min_docs: int = 1, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, docs, occurrences)``: distinct documents and occurrences of the terms that ``min_docs`` documents of a language may hold."""
    columns = (text_col, lang_col, source_col)
    known = chunk_counts(docs, columns).groupBy("chunk").agg(F.sum("docs").alias("docs"))
    parsed = materialize(known.select("chunk", "docs", F.explode(chunk_terms(F.col("chunk"))).alias("t")).select("chunk", "docs", "t.term", "t.k"), "chunks")
    enough = materialize(parsed.groupBy("term").agg(F.sum("docs").alias("most")).where(F.col("most") >= min_docs).select("term"), "enough")
    terms = materialize(parsed.join(F.broadcast(enough) if _is_small(enough, "term") else enough, "term", "left_semi").select("chunk", "term", "k"), "chunk-terms")
    if _is_small(terms, "chunk", "term"):
        counted = counts_in_blocks(docs, columns, terms.toArrow())
    else:
        postings = materialize(_with_terms(chunk_postings(docs, columns), terms), "postings")
        counted = postings.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first()).mapInArrow(_merge, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def _with_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of each term of each chunk; the rows of sources, which have no chunk, keep none."""
    joined = postings.join(terms, "chunk", "left").where(F.col("term").isNotNull() | F.col("sources").isNotNull())
    return joined.select("block", "lang", "sources", "term", "k", "docs", "times")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10⁹·(count + 5) / (total + 5·kept)), exact."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + SMOOTH, 19) * wide(F.lit(UNIT), 10), wide(total + SMOOTH * kept, 19))


def _distances(key, heads: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """Of the terms of a bucket: the sum of |p − q| for each two sources."""
    heads = heads.sort_values("source")
    names = heads["source"].tolist()
    place = {s: i for i, s in enumerate(names)}
    rows, _ = pd.factorize(terms["term"])
    p = np.tile(heads["p0"].to_numpy(np.int64), (rows.max(initial=-1) + 1, 1))
    p[rows, terms["source"].map(place).to_numpy(np.int64)] = terms["p"].to_numpy(np.int64)
    out = pd.DataFrame({"lang": key[0], "source": names, "items": [names] * len(names), "value": [np.abs(p - p[:, [i]]).sum(axis=0, dtype=np.int64).tolist() for i in range(len(names))]})
    return out[["lang", "source", "items", "value"]]


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of the sources of a language (``pair``), and each source's most over-used terms (``term``)."""
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    groups = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct()
    counts = materialize(term_counts(docs, min_docs, text_col, lang_col, source_col), "terms")
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("in_lang")).where(F.col("docs") >= min_docs)
    kept = materialize(counts.join(whole.select("lang", "term", "in_lang"), ["lang", "term"]).select("lang", "source", "term", "occurrences", "in_lang"), "kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.sum("occurrences").alias("lang_total")), "lang", "left").join(kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["lang_total", "v"])
    # A bucket has many more terms than sources, so what it returns is less than what it reads.
    cells = F.greatest(F.lit(CELLS).cast("long"), 4 * F.col("sources") * F.col("sources"))
    langs = langs.withColumn("buckets", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") * F.col("sources") / cells)))
    totals = materialize(groups.join(kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("total")), ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang"), "totals")
    scored = kept.join(totals, ["lang", "source"]).select("lang", "source", "term", share(F.col("occurrences"), F.col("total"), F.col("v")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("v")).alias("q"), "buckets")
    # No kept term: no share, and the distance 0.
    heads = totals.select("lang", "source", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1).alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    dealt = scored.select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "source", "term", "p")
    sums = heads.groupBy("lang", "bucket").cogroup(dealt.groupBy("lang", "bucket")).applyInPandas(_distances, "lang string, source string, items array<string>, value array<long>")
    each = sums.select("lang", "source", F.explode(F.arrays_zip("items", "value")).alias("x")).where(F.col("x.items") != F.col("source"))
    pairs = each.groupBy("lang", "source", F.col("x.items").alias("item")).agg(F.sum("x.value").alias("value")).withColumn("part", F.lit("pair"))
    terms = scored.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).union(best.select(columns))
