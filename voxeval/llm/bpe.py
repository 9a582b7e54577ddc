"""BPE encoding and decoding with word ends.

A text is split at added tokens, normalised (NFC, white space, lower case) and cut into words by the vocabulary's pattern.
A word is encoded over a contiguous array of part boundaries and the ranks of adjacent parts: the first smallest rank is
looked for, its inner boundary deleted and the neighbouring ranks refreshed, until no pair has a rank. Long words, for
which repeated scans would be quadratic, take the same merges from a heap. Tasks keep the ids of words they met in a
bounded table. The vocabulary is read once by the driver and broadcast; its size is that of the file, whatever the data.

Defined cases: null is the empty text, with no ids and an empty decoded text; repeated rows and other columns are passed
by, but for one with the name of the result, which the result replaces; an empty table has an empty result; an id outside
the vocabulary decodes to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import portions

#: Parts up to which the rank array is scanned.
SHORT_PARTS = 256
#: Words, and chunks between white space, whose ids a worker remembers before it starts anew, and their length at most.
REMEMBERED, REMEMBERED_BYTES = 150_000, 64
NONE = 1 << 60
# Ranges in which newer Unicode versions have letters and numbers that the library's tables don't have.
NEWER = """
558 58b-58c 88f c5c cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10d50-10d65
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
UNKNOWN = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")
# Lower case of letters that Python's tables don't have yet and the library's do.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: A sign, neither letter nor number, that stands for them when words are cut.
STANDIN = "\uf8ff"
#: Characters that ``str.split`` takes for white space and the patterns of vocabularies don't.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merge_scan(parts: list[int], ranks: dict[int, int], joined: list[int]) -> list[int]:
    """Merge a short word; ``parts`` are the ids between its boundaries, ``ranks`` go by the pair ``left << 20 | right``."""
    pair = [ranks.get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        parts[i] = joined[least]
        del parts[i + 1], pair[i]  # the boundary between the two goes
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] << 20 | parts[i], NONE)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] << 20 | parts[i + 1], NONE)
    return parts


def merge_heap(parts: list[int], ranks: dict[int, int], joined: list[int]) -> list[int]:
    """The same merges by a heap of (rank, place), for long words."""
    n = len(parts)
    after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n

    def rank(i: int) -> int:
        j = after[i]
        return NONE if j >= n else ranks.get(parts[i] << 20 | parts[j], NONE)

    heap = [(r, i) for i in range(n) if (r := rank(i)) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or rank(i) != r:
            continue
        j = after[i]
        parts[i], alive[j], after[i] = joined[r], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (q := rank(k)) != NONE:
                heapq.heappush(heap, (q, k))
    return [p for p, live in zip(parts, alive) if live]


class WordBpe:
    """Encoder and decoder of a vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"]
        self.ranks: dict[int, int] = {}  # by left id << 20 | right id
        self.joined: list[int] = []
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[left] << 20 | self.vocab[right]] = rank
            self.joined.append(self.vocab[left + right])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.inner, self.last = ([self.vocab[c + e] for c in byte_symbols()] for e in ("", end))
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def tokens(self) -> list[str]:
        """Token by id; ids without a token are empty."""
        out = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, i in (*self.vocab.items(), *self.added.items()):
            out[i] = t
        return out

    def forget(self) -> None:
        self.words.clear()
        self.chunks.clear()

    def normalise(self, text: str) -> str:
        # lower-casing goes by character, so a sigma has one lower case wherever it stands
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word_ids(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is not None:
            return known
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        ids = array("i", (merge_scan if len(parts) <= SHORT_PARTS else merge_heap)(parts, self.ranks, self.joined)).tobytes()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(raw) <= REMEMBERED_BYTES:
            self.words[word] = ids
        return ids

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a text without added tokens."""
        text = self.normalise(chunk)
        if text.isascii() or not UNKNOWN.search(text):
            return b"".join([self.word_ids(w) for w in self.pattern.findall(text)])
        text = text.translate(LOWER)
        shape = UNKNOWN.sub(STANDIN, text)
        return b"".join([self.word_ids(text[m.start() : m.end()]) for m in self.pattern.finditer(shape)])

    def encode(self, text: str) -> bytes:
        """Ids as consecutive 32-bit numbers."""
        if self.specials is not None and any(a in text for a in self.added):
            return b"".join(array("i", [self.added[x]]).tobytes() if x in self.added else self._plain(x) for x in self.specials.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if NOT_SPACE.search(text):
            return self.chunk_ids(text)
        known, out = self.chunks, []  # words never reach over white space, nor does the normal form
        for chunk in text.split():
            ids = known.get(chunk)
            if ids is None:
                ids = self.chunk_ids(chunk)
                if len(known) > REMEMBERED:
                    known.clear()
                if len(chunk) <= REMEMBERED_BYTES:
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


_ready: dict[str, WordBpe] = {}


def _coder(text: str) -> WordBpe:
    """The coder of a vocabulary, kept by the worker process for its next tasks."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _ready:
        _ready.clear()
        _ready[name] = WordBpe(json.loads(text))
    return _ready[name]


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _ids_of(bpe: WordBpe, texts: pa.Array) -> pa.ListArray:
    coded = [bpe.encode(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, coded)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _text_of(names: pa.Array, lists: pa.ListArray) -> pa.Array:
    lists = lists.fill_null([]) if lists.null_count else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    good = (flat >= 0) & (flat < len(names))
    if not good.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)[good]
        flat, sizes = flat[good], np.bincount(owner, minlength=len(sizes))
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(flat))), " ")


def _given_back(bpe: WordBpe) -> None:
    """A worker process lives on after its task: what it remembered is dropped, and freed memory goes back to the system."""
    bpe.forget()
    pa.default_memory_pool().release_unused()


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


IDS, DECODED = T.ArrayType(T.IntegerType()), T.StringType()


def encode(df: DataFrame, vocabulary: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as an array of int; ``vocabulary`` is a path the driver can read."""
    df = df.drop(into)
    spec, place = _shared(df, vocabulary), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(spec.value)
        for b in portions(batches):
            yield _put(b, into, _ids_of(bpe, b.column(place)))
        _given_back(bpe)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, IDS)]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the tokens of ``ids``, word-end marks included, joined by one space."""
    df = df.drop(into)
    spec, place = _shared(df, vocabulary), df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(spec.value)
        names = pa.array(bpe.tokens(), pa.string())
        for b in portions(batches):
            yield _put(b, into, _text_of(names, b.column(place)))
        _given_back(bpe)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, DECODED)]))


def coded(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ids and what they decode to in place of ``text``: one pass, one worker process a task."""
    df = df.drop(ids, decoded)
    spec, place = _shared(df, vocabulary), df.columns.index(text)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(spec.value)
        names = pa.array(bpe.tokens(), pa.string())
        for b in portions(batches):
            lists = _ids_of(bpe, b.column(place))
            cols = [c for i, c in enumerate(b.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*cols, lists, _text_of(names, lists)], names=[*(f.name for f in rest), ids, decoded])
        _given_back(bpe)

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(ids, IDS), T.StructField(decoded, DECODED)]))
