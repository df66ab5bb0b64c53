"""Token-id files: flat unsigned 32-bit ids with 64-bit document offsets, memory-mapped.

A data set is a set of parts. Part files are ``<name>.ids`` (little-endian
unsigned ids of all its documents, of 16 bits if the vocabulary allows, else 32), ``<name>.offsets`` (64-bit: where
each document starts in the part, and the end) and ``<name>.docs`` (64-bit
document ids). Parts hold consecutive ranges of document ids. The manifest has
a row for each part; the prefix sums of its counts give the base of each part.

Each attempt of a task writes files of its own name and reports that name; only
what successful tasks report is in the manifest, so lost executors and repeated
tasks leave no wrong data. Parts are closed at ``PART_IDS`` ids.

Defined results: a null text is an empty one, of which only the end id stays;
rows with equal ids follow each other by their text hash, a group of them may
span parts; texts of any length are encoded whole; columns other than the id and
the text are never read, so their names cannot clash; an empty table makes an
empty data set.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.bpe_stream import Remembered, byte_alphabet
from scoreloom.llm.shared import materialize, new_folder, rows_of

#: A part is closed when it holds this many ids (128 MB at most).
PART_IDS = 32 << 20
CACHE_RUNS, CACHE_WORDS, CACHE_TAILS = 150_000, 500_000, 50_000
#: White space other than space and line feed; texts that hold any go to the library whole.
RARE_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = string.punctuation
#: Letters before this one are letters in every version of Unicode that a library may know.
LAST_OLD_LETTER = "\u0250"


def id_format(vocabulary: int) -> tuple[str, str]:
    """``struct`` code and numpy type of the ids of a vocabulary of this size."""
    return ("H", "<u2") if vocabulary <= 1 << 16 else ("I", "<u4")


class CachedLibraryTokenizer:
    """The tokenizers library's ids of whole texts; words are encoded once and kept.

    A byte-level pattern takes a space only at the start of a piece, and a line
    feed between other characters is a piece of its own. So where a single space
    or line feed stands between other characters no piece spans its left side,
    and the library's ids of a text are those of its runs. In a run of letters and
    then ASCII marks both are pieces, so the library's model takes such a word
    without its pattern. Texts with any other white space go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.apart = [*(t.content for t in self.library.get_added_tokens_decoder().values()), "  ", "\n ", " \n", "\n\n", *RARE_SPACE]
        self.code, self.dtype = id_format(self.library.get_vocab_size(with_added_tokens=True))
        self.step = np.dtype(self.dtype).itemsize
        self.shown, self.model = dict(enumerate(byte_alphabet())), self.library.model
        self.feed, self.space = self.whole("\n"), self.shown[0x20]
        self.words = Remembered(self._word, CACHE_WORDS)
        self.runs = Remembered(self._run, CACHE_RUNS)
        self.tails = Remembered(self.whole, CACHE_TAILS)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _run(self, run: str) -> bytes:
        body = run.rstrip(MARKS)
        word = body.removeprefix("\n")
        if not word.isalpha() or not word.isascii() and max(word) >= LAST_OLD_LETTER:
            return self.whole(run if run.startswith("\n") else " " + run)
        return self.words[body] + self.tails[run[len(body) :]] if len(body) < len(run) else self.words[body]

    def _word(self, body: str) -> bytes:
        """A piece of letters alone, after a space or a line feed."""
        feed = body[0] == "\n"
        word = body[feed:]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(word if feed else self.space + word)]
        packed = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return self.feed + packed if feed else packed

    def _of_runs(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without white space but single spaces and line feeds between other characters: each different run is looked up once."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        runs, bounds = parts.values.dictionary_encode(), parts.offsets.to_numpy()
        known = self.words.get
        packed = [known(x) or self.runs[x] for x in runs.dictionary.to_numpy(zero_copy_only=False).tolist()]
        # No space stands before the head of a text.
        at = runs.indices.to_numpy().copy()
        at[bounds[:-1]] = len(packed) + np.arange(len(texts))
        packed += map(self.tails.__getitem__, parts.values.take(pa.array(bounds[:-1])).to_pylist())
        ids = pa.array(packed, pa.large_binary()).take(pa.array(at))
        cuts, data = np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist(), memoryview(ids.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of the format's width."""
        # Plain searches: on whole texts they take a ninth of the time of one compiled class.
        plain = [bool(t) and not (t[0].isspace() or t[-1].isspace() or any(x in t for x in self.apart)) for t in texts]
        of_runs = iter(self._of_runs([t for t, x in zip(texts, plain, strict=True) if x]) if any(plain) else [])
        return [next(of_runs) if x else self.whole(t) for t, x in zip(texts, plain, strict=True)]


_LOADED: dict[str, CachedLibraryTokenizer] = {}


def library_at(path: str) -> CachedLibraryTokenizer:
    if path not in _LOADED:
        _LOADED[path] = CachedLibraryTokenizer(path)
    return _LOADED[path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, as the library's URI rules find it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _write_files(rows: DataFrame, encoder: Callable[[], tuple[Callable, int]], folder: str, parts: int | None) -> DataFrame:
    """Writes ``rows(id, k1, data)`` by id and returns the manifest ``(part, piece, name, n_docs, n_ids, id_bytes, base)``.

    ``encoder`` gives, in a task, the function from values of ``data`` to packed ids with the
    end id of each, and the width of an id. Rows are range-partitioned and sorted by id, so the files follow
    in ascending order; each task encodes its rows once and writes them as it goes.
    """
    rows = rows.withColumn("k2", F.monotonically_increasing_id())
    rows = (rows.repartitionByRange(parts, "id", "k1", "k2") if parts else rows.repartitionByRange("id", "k1", "k2")).sortWithinPartitions("id", "k1", "k2").select("id", "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder()
        context, (fs, root) = TaskContext.get(), _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, made = context.partitionId(), []

        def begin():
            name = f"part-{part:06d}-{len(made):05d}-{context.taskAttemptId()}"
            return {"name": name, "ids": fs.open_output_stream(f"{root}/{name}.ids"), "ends": [0], "docs": []}

        def close(x):
            x["ids"].close()
            for kind, values in (("offsets", x["ends"]), ("docs", x["docs"])):
                with fs.open_output_stream(f"{root}/{x['name']}.{kind}") as out:
                    out.write(np.array(values, "<i8").tobytes())
            made.append((x["name"], len(x["docs"]), x["ends"][-1], step))

        now = None
        for batch in batches:
            for rows, values in rows_of(batch, "data"):
                for doc, packed in zip(rows.column("id").to_pylist(), encode(values), strict=True):
                    now = now or begin()
                    now["ids"].write(packed)
                    now["ends"].append(now["ends"][-1] + len(packed) // step)
                    now["docs"].append(-(1 << 63) if doc is None else doc)
                    if now["ends"][-1] >= PART_IDS:
                        close(now)
                        now = None
        if now:
            close(now)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int32())], ["part", "piece", "name", "n_docs", "n_ids", "id_bytes"])

    written = materialize(rows.mapInArrow(write, "part int, piece int, name string, n_docs long, n_ids long, id_bytes int"), "manifest")
    # A row for each file of up to 128 MB: the one window over all of them is as small as the manifest.
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encodes the texts with the tokenizers library, writes the data set and returns its manifest."""

    def encoder():
        tokenizer = library_at(tokenizer_path)
        end = struct.pack(f"<{tokenizer.code}", end_id)
        return lambda texts: [ids + end for ids in tokenizer.encode_all(texts)], tokenizer.step

    return _write_files(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("k1"), F.col(text_col).cast("string").alias("data")), encoder, folder, parts)


def write_ids(encoded: DataFrame, vocabulary: int, end_id: int, folder: str, id_col: str = "doc_id", ids_col: str = "ids", parts: int | None = None) -> DataFrame:
    """Writes ids that are there already (little-endian, unsigned, 32 bits, in a binary column) and returns the manifest."""

    def encoder():
        code, dtype = id_format(vocabulary)
        end = struct.pack(f"<{code}", end_id)
        return lambda values: [np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end for ids in values], np.dtype(dtype).itemsize

    return _write_files(encoded.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(ids_col).alias("k1"), F.col(ids_col).alias("data")), encoder, folder, parts)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the memory-mapped files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in batches:
            for name, width, base in zip(*(batch.column(c).to_pylist() for c in ("name", "id_bytes", "base")), strict=True):

                def mapped(kind, dtype, path=f"{root}/{name}"):
                    if local:
                        return np.memmap(f"{path}.{kind}", dtype, "r")
                    with fs.open_input_file(f"{path}.{kind}") as f:
                        return np.frombuffer(f.read_buffer(), dtype)

                ids, ends, docs = mapped("ids", f"<u{width}"), mapped("offsets", "<i8"), mapped("docs", "<i8")
                for at in range(0, len(docs), 100_000):
                    cut = ends[at : at + 100_001]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    own = docs[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == -(1 << 63)), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("name", "id_bytes", "base").repartition(min(files, 10_000)).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of all documents to the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "token-files")
    manifest = materialize(write_token_files(docs, tokenizer_path, end_id, folder, id_col, text_col), "bases")
    return read_token_files(docs.sparkSession, folder, manifest)
