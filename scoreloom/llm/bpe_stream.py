"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

``MergeTable.lookahead`` is computed from the merge list alone. Appending
symbols to a word can change its tokens only to the left of the old end, one
merge at a time: a merge ``(a, b)`` whose right part starts at the edge of the
changed region moves the edge left by ``len(a)``. The next such merge must have
a higher rank and a right part that starts with the text of ``a``. The longest
chain of that kind, summed over the lengths of the left parts, bounds how far a
change can reach. Tokens that end further than this before the end of what has
been read are stable, so a word of any length is encoded from a window of fixed
size. A text passes through in blocks that end at white space, where all tokens
are stable; ids leave block by block and go on to the decoder. Decoding is a state
machine: whether a token came before (for tokens that stand apart by spaces), or
the bytes of at most one unfinished character (for readable text).

Defined results: a null text encodes as an empty one (no ids, empty decoded
text); strings of special tokens in a text become their ids, as in the
tokenizer itself; repeated rows and clashing columns change nothing; texts and
words of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import rows_of

#: Words, and runs between white space, that a worker keeps encoded in each of two generations.
CACHE_WORDS, CACHE_CHUNKS = 400_000, 150_000
_NONE = 1 << 30
#: Characters of a block, at least; the next white space ends it.
BLOCK = 1 << 16
#: White space as the tokenizer's patterns know it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Remembered(dict):
    """A bounded cache of ``make(key)``: when full, the older of two generations goes."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeTable:
    """The merges of a byte-level BPE vocabulary, over token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_alphabet()
        self.byte_id = [vocab[c] for c in letters]
        self.last_id = [vocab[c + suffix] for c in letters]
        self.suffix, self.decoder = suffix, spec.get("decoder")
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.longest = max(len(self.bytes_of(i)) for i in vocab.values())
        self.lookahead = self._lookahead(pairs)

    def bytes_of(self, token_id: int) -> str:
        token = self.tokens[token_id]
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def _lookahead(self, pairs: list[list[str]]) -> int:
        """The length of the longest chain of left parts by which a change at the end can travel, and one token."""
        reach: dict[str, int] = {}
        longest = 0
        for a, b in pairs:
            body = b[: -len(self.suffix)] if self.suffix and b.endswith(self.suffix) else b
            far = len(a) + max((reach.get(body[:n], 0) for n in range(1, len(body) + 1)), default=0)
            if far > reach.get(a, 0):
                reach[a] = far
            longest = max(longest, far)
        return longest + self.longest

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of a whole run of symbols: always the pair of least rank, the leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, made = self.rank, self.made
        ranks = [rank.get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank.get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (q := rank.get(ids[left] << 20 | ids[after[left]])) is not None:
                    heapq.heappush(queue, (q, left))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes) -> list[int]:
        """One word; longer ones stream through a window of fixed size."""
        if len(word) > self.longest:
            return [t for part in self.stream_word(word) for t in part]
        ids = [self.byte_id[b] for b in word]
        ids[-1:] = [self.last_id[b] for b in word[-1:]]
        return self.merge(ids)

    def stream_word(self, word: bytes, window: int = 0) -> Iterator[list[int]]:
        """Tokens of ``word`` as soon as they are stable."""
        window = max(window, 2 * self.lookahead + 2 * self.longest)
        at = 0
        while at < len(word):
            part = word[at : at + window]
            ids = [self.byte_id[b] for b in part]
            if at + window >= len(word):
                ids[-1] = self.last_id[part[-1]]
                yield self.merge(ids)
                return
            stable, end = [], 0
            for token in self.merge(ids):
                end += len(self.bytes_of(token))
                if end > len(part) - self.lookahead:
                    break
                stable.append(token)
                at += len(self.bytes_of(token))
            yield stable


class WordTokenizer:
    """Encodes as a lower-casing word BPE tokenizer file says: normal form, words, bytes, merges."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        self.table = MergeTable(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"[^\s", f"[^{_SPACE}"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.table.special)) + ")")
        self.gap = regex.compile(f"[{_SPACE}]+")
        self.packed = Remembered(self._pack, min(CACHE_CHUNKS, words))
        self.word = Remembered(self._encode_word, words)
        size = max(self.table.tokens) + 1
        self.piece = [self.table.tokens.get(i, "").encode() for i in range(size)]
        self.is_special = np.zeros(size, bool)
        self.is_special[list(self.table.special.values())] = True
        self.spelled = [b"" if self.is_special[i] or i not in self.table.tokens else self._spelled(i) for i in range(size)]

    def _spelled(self, token_id: int) -> bytes:
        """The bytes that a token stands for, with a space after the end of a word."""
        table, token = self.table, self.table.tokens[token_id]
        ended = bool(table.suffix) and token.endswith(table.suffix)
        return bytes(table.byte_of[c] for c in table.bytes_of(token_id)) + b" " * ended

    @staticmethod
    def _normal(chunk: str) -> str:
        return (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()

    def _pack(self, chunk: str) -> bytes:
        """The ids of a run of text without white space."""
        chunk = self._normal(chunk)
        if chunk.isalpha():
            return self.word[chunk]
        body, last = chunk[:-1], chunk[-1:]
        if last in ",." and body.isalpha():
            return self.word[body] + self.word[last]
        return b"".join(map(self.word.__getitem__, self.words.findall(chunk)))

    def _encode_word(self, word: str) -> bytes:
        ids = self.table.encode_word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, block by block."""
        at = 0
        while at < len(text):
            cut = self.gap.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = cut.end() if cut else len(text)
            if end - at > 4 * BLOCK:
                yield from self._long_runs(text[at:end])
            else:
                yield self._block(text[at:end])
            at = end

    def _special_parts(self, text: str) -> list[str]:
        """Plain text at even places, special tokens at odd ones."""
        return self.special.split(text) if "<|" in text else [text]

    def _block(self, text: str) -> bytes:
        parts = self._special_parts(text)
        if len(parts) == 1:
            return self.encode_plain(text)
        return b"".join(struct.pack("<I", self.table.special[p]) if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))

    def _long_runs(self, text: str) -> Iterator[bytes]:
        """A block with a run of very many characters: its words leave one by one, and long words as their tokens get stable."""
        for i, part in enumerate(self._special_parts(text)):
            if i % 2:
                yield struct.pack("<I", self.table.special[part])
                continue
            for run in filter(None, self.gap.split(part)):
                for word in self.words.finditer(self._normal(run)):
                    if len(word[0]) <= self.table.longest:
                        yield self.word[word[0]]
                        continue
                    for ids in self.table.stream_word(word[0].encode()):
                        yield struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_blocks(text))

    def encode_plain(self, text: str) -> bytes:
        chunks = text.split() if not any(c in text for c in _SEPARATORS) else [c for c in self.gap.split(text) if c]
        return b"".join(map(self.packed.__getitem__, chunks))

    def decode(self, ids: list[int]) -> bytes:
        """As the tokenizer's own decode."""
        machine = Decoder(self)
        return machine.feed(np.array(ids, np.uint32)) + machine.finish()


class Decoder:
    """The incremental machine from ids to UTF-8: ids in any blocks give the same bytes.

    ``readable`` text is made of the tokens' bytes, which may end in the middle of
    a character. Otherwise the text is the tokenizer's own: a kind of file without
    a decoder sets its tokens apart by spaces.
    """

    def __init__(self, tokenizer: WordTokenizer, readable: bool = False):
        self.tokenizer, self.apart = tokenizer, tokenizer.table.decoder is None and not readable
        self.machine, self.started = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: np.ndarray) -> bytes:
        tokens = ids.tolist()
        if self.apart:
            out = b" " * (self.started and bool(tokens)) + b" ".join(map(self.tokenizer.piece.__getitem__, tokens))
            self.started = self.started or bool(tokens)
            return out
        out, at = [], 0
        for k in np.flatnonzero(self.tokenizer.is_special[ids]).tolist():
            out += [self._text(tokens[at:k]), self.finish(), self.tokenizer.piece[tokens[k]]]
            at = k + 1
        return b"".join([*out, self._text(tokens[at:])])

    def _text(self, tokens: list[int]) -> bytes:
        return self.machine.decode(b"".join(map(self.tokenizer.spelled.__getitem__, tokens))).encode()

    def finish(self) -> bytes:
        left = b"" if self.apart else self.machine.decode(b"", True).encode()
        self.machine.reset()
        return left


_LOADED: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_at(path: str, words: int = CACHE_WORDS) -> WordTokenizer:
    """The tokenizer of a file, loaded once in a worker, which keeps so many words encoded in each generation."""
    if (path, words) not in _LOADED:
        _LOADED[path, words] = WordTokenizer(path, words)
    return _LOADED[path, words]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: each text's ids as little-endian unsigned 32-bit integers in a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([tokenizer.encode(t) for t in texts], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "id long, ids binary")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, words: int = CACHE_WORDS) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, readable_sha256)``: each block of ids is digested, decoded and dropped.

    With ``keep_ids`` they stay, in a binary column ``ids``. Fewer remembered ``words`` take less memory and more time.
    """
    names = ("ids_sha256", "decoded_sha256", "readable_sha256")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path, words)
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                counts, hexes, kept = [], [], []
                for text in texts:
                    machines, digests, n, blocks = (Decoder(tokenizer), Decoder(tokenizer, readable=True)), [hashlib.sha256() for _ in names], 0, []
                    for packed in tokenizer.encode_blocks(text):
                        ids = np.frombuffer(packed, "<u4")
                        n += len(ids)
                        if keep_ids:
                            blocks.append(packed)
                        for to, data in zip(digests, (packed, *(m.feed(ids) for m in machines)), strict=True):
                            to.update(data)
                    for to, machine in zip(digests[1:], machines, strict=True):
                        to.update(machine.finish())
                    counts.append(n)
                    hexes.append([d.hexdigest() for d in digests])
                    kept.append(b"".join(blocks))
                columns = [part.column("id"), pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in zip(*hexes, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if keep_ids else [])], ["id", "n_tokens", *names, *(["ids"] if keep_ids else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digest, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, readable_sha256 string" + ", ids binary" * keep_ids)
