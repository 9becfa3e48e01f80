"""Byte-level BPE as a lazily determinised finite-state transducer.

A state of the transducer is what the bytes read so far leave undecided: the bytes after the last
token that no continuation can change, and for each cut in them that a later token could start from,
the token that ends there.  A token sequence is the BPE encoding of its bytes exactly if each
neighbouring pair is the encoding of its own bytes, so the token ending at a new position is found
from the live cuts alone.  Reading a byte emits the tokens that all live cuts have in common; the
lookahead is bounded by the longest vocabulary entry.  States and arcs are made when text first
needs them and kept per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Upper bounds of what one worker keeps; beyond them the memo starts afresh (results don't change).
MEMO_WORDS, MEMO_STATES = 400_000, 400_000
#: Largest vocabulary file that is broadcast.
MOST_VOCABULARY_BYTES = 32 << 20
_SPLIT = regex.compile(PATTERN)


class _State:
    __slots__ = ("arcs", "rest", "last", "tail")

    def __init__(self, last: int, rest: bytes, tail: tuple[int, ...]):
        self.last, self.rest, self.tail, self.arcs = last, rest, tail, {}


class Transducer:
    """Maps the UTF-8 bytes of one pre-token to token ids (little-endian int32 bytes)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {i: w for w, i in ranks.items()}
        self.prefixes = {w[:k] for w in ranks for k in range(1, len(w))}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._states: dict[tuple, _State] = {}
        self.start = self._state(-1, b"", ())

    @classmethod
    def read(cls, raw: bytes) -> Transducer:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})

    def _state(self, last: int, rest: bytes, tail: tuple[int, ...]) -> _State:
        key = (last, rest, tail)
        if (s := self._states.get(key)) is None:
            s = self._states[key] = _State(last, rest, tail)
        return s

    def merged(self, word: bytes) -> list[int]:
        """The defining procedure: merge the pair of lowest rank until none is left."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether token ``right`` may follow token ``left`` (-1: stands at the start)."""
        if (ok := self._pairs.get((left, right))) is None:
            if len(self._pairs) > MEMO_STATES:
                self._pairs.clear()
            whole, want = (self.words[right], [right]) if left < 0 else (self.words[left] + self.words[right], [left, right])
            ok = self._pairs[left, right] = self.merged(whole) == want
        return ok

    def _arc(self, s: _State, byte: int) -> tuple[_State, bytes]:
        rest = s.rest + bytes((byte,))
        n, ends = len(rest), [s.last, *s.tail]
        new = next(t for i in range(n) if (i == 0 or ends[i] >= 0) and (t := self.ranks.get(rest[i:])) is not None and self._fits(ends[i], t))
        ends.append(new)
        words, paths = self.words, []
        for p in range(n, -1, -1):
            if p == n or (p == 0 or ends[p] >= 0) and rest[p:] in self.prefixes:
                path = [p]
                while path[-1] > 0:
                    path.append(path[-1] - len(words[ends[path[-1]]]))
                paths.append(path[::-1])
        shared = 0
        for level in zip(*paths):
            if len(set(level)) > 1:
                break
            shared += 1
        root, used = paths[0][shared - 1], {p for path in paths for p in path}
        out = np.array([ends[p] for p in paths[0][1:shared]], "<i4").tobytes()
        tail = tuple(ends[p] if p in used else -1 for p in range(root + 1, n + 1))
        return self._state(ends[root], rest[root:], tail), out

    def _flush(self, s: _State) -> bytes:
        out, p = [], len(s.rest)
        while p > 0:
            out.append(s.tail[p - 1])
            p -= len(self.words[out[-1]])
        return np.array(out[::-1], "<i4").tobytes()

    def word(self, word: bytes) -> bytes:
        s, out = self.start, []
        for b in word:
            arc = s.arcs.get(b)
            if arc is None:
                if len(self._states) > MEMO_STATES:
                    self._states.clear()
                    self.start.arcs.clear()
                arc = s.arcs[b] = self._arc(s, b)
            s = arc[0]
            if arc[1]:
                out.append(arc[1])
        arc = s.arcs.get(-1)
        if arc is None:
            arc = s.arcs[-1] = (s, self._flush(s))
        out.append(arc[1])
        return b"".join(out)


class Encoder(dict):
    """Texts to ids; as a mapping, pre-tokens to their ids as bytes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        ids = self.transducer.word(word.encode("utf-8", "surrogatepass"))
        if len(word) < 200:
            self[word] = ids
        return ids

    def bytes_of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _SPLIT.findall(text))) if text else b""

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.bytes_of(text), "<i4")


class Utf8Stream:
    """Incremental UTF-8 decoding of token bytes: a character is given out once it is complete.

    The state is the number of continuation bytes due and the range the next one must lie in; a byte
    that fits no sequence, or an unfinished end, gives U+FFFD as the standard's maximal-subpart rule says.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out, i = [], 0
        if not self.due and data.isascii():
            return data.decode("ascii")
        while i < len(data):
            b = data[i]
            if self.due:
                if self.low <= b <= self.high:
                    self.value, self.due, self.low, self.high = self.value << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    i += 1
                else:
                    out.append("�")
                    self.due, self.low, self.high = 0, 0x80, 0xBF
                continue
            i += 1
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        due, self.due, self.low, self.high = self.due, 0, 0x80, 0xBF
        return "�" if due else ""


def decode(ids: Iterable[int], words: dict[int, bytes]) -> Iterator[str]:
    """Text pieces of a stream of ids; joined, they are the text."""
    stream = Utf8Stream()
    for i in ids:
        if piece := stream.feed(words[i]):
            yield piece
    if piece := stream.close():
        yield piece


_LOADED: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for a vocabulary file's content; kept between tasks."""
    key = hashlib.md5(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Transducer.read(raw))
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast of the content of a vocabulary file (a published file, the 50k one under 1 MB) behind a check of its size."""
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        raw = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError("this file is too large for a vocabulary")
    return spark.sparkContext.broadcast(raw)


def _lists(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text;
    a null id stays null; repeated rows stay repeated; other columns are not carried.  Nothing is
    shuffled: each Arrow batch is encoded where it is read.
    """
    vocab = vocabulary(df.sparkSession, path)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 1000):
                parts = [enc.bytes_of(t) for t in texts.slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(parts)), _lists(parts)], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens int`` of every row: the length of what ``encode_corpus`` gives."""
    vocab = vocabulary(df.sparkSession, path)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            sizes = [len(enc.bytes_of(t)) >> 2 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; a null list gives null, an empty list an empty text."""
    vocab = vocabulary(df.sparkSession, path)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocab.value).transducer.words
        for batch in batches:
            texts = [None if x is None else "".join(decode(x, words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "ids")


def p6_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source: rows, tokens and tokens per character, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = count_tokens(docs.select(F.struct("source", F.length("text").alias("n")).alias("key"), "text"), "key")
    return sizes.groupBy(F.col("key.source").alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("key.n").alias("characters")
    )
