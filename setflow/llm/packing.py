"""Packing: documents as token ids, packed into sequences of `window` tokens by best-fit decreasing.

Method. A document's ids and its end id are cut into full windows and one remainder. Full windows are sequences
of their own and are never shuffled. Remainders are dealt to shards by their place in the table of pieces; in a shard
they are taken longest first, and a segment tree over remaining capacities (1 to window) finds the open sequence that they
fill most tightly. Each shard is packed on its own: only its last few sequences stay loose. A last loose sequence is
not split: it is padded, except where its length is a power of two.

Tokens. Ids are those of `tokenizers`. White space and words are tokenised once and remembered by their bytes, since
byte-level BPE never merges over the places where this module cuts; texts with white space beyond ASCII are
tokenised whole. Special tokens of the file (added tokens) stand for themselves: texts are cut around them first. Words of
Latin characters may go through tiktoken, which runs the same merges several times as fast, but only with a file of ranks
that holds exactly the merges of the tokenizer file, in their order, which is compared entry by entry when it is loaded.

Defined cases: a null or empty text packs as its end id alone; a text of any length is cut into windows, tokenised slice
by slice in one task; the strings of special tokens become their ids, as the tokenizer does by itself; pieces of equal
length are taken in the order of the table of pieces; repeated rows and keys are packed as often as they occur; a null
key stays null, and keys keep their type; an empty table gives an empty result; other columns are not read, so they can't
clash.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C

WINDOW = 2048
END_ID = 1
SHARD_PIECES = 50_000
#: Remembered units; beyond, the memory starts anew (ids don't depend on it).
MEMORY = 1 << 19

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

_LATIN = re.compile("[\x00-\u024f]*")
_JOINT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def slices(text: str, most: int = C.SLICE) -> Iterator[str]:
    """A text cut before words that follow a single space; no token spans such a place."""
    a = 0
    while a < len(text):
        joint = _JOINT.search(text, a + most)
        b = joint.start() if joint else len(text)
        yield text[a:b]
        a = b


def ranks_of_merges(path: str) -> dict[bytes, int]:
    """Bytes and id of every token that the merges of a byte-level BPE file can make; ids rise with the order of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    raw = lambda token: bytes(byte[c] for c in token)
    out = {raw(t): model["vocab"][t] for t in byte}
    last = max(out.values())
    for pair in model["merges"]:
        token = "".join(pair if isinstance(pair, list) else pair.split(" "))
        if model["vocab"][token] <= last:
            raise ValueError("merges are not in the order of ids")
        out[raw(token)] = last = model["vocab"][token]
    return out


class Memo:
    """Token ids of units, in numpy arrays; unit 0 has none."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.gaps: dict[tuple[bytes, bool], int] = {}
        self.offset = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n, self.used = 1, 0

    def add(self, ids: list[list[int]]) -> int:
        """The number of the first of these units."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        first, n, used = self.n, self.n + len(ids), self.used + int(lengths.sum())
        if n > len(self.offset):
            self.offset, self.length = np.resize(self.offset, C.next_pow2(n)), np.resize(self.length, C.next_pow2(n))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, C.next_pow2(used))
        self.ids[self.used : used] = np.fromiter(chain.from_iterable(ids), np.uint32, used - self.used)
        self.offset[first:n], self.length[first:n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.n, self.used = n, used
        return first


class Encoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False) of the tokenizer file."""

    def __init__(self, path: str, ranks: str | None = None, most: int = MEMORY):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if table != ranks_of_merges(path):
                raise ValueError(f"{ranks} doesn't hold the merges of {path}")
            self.fast = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        added = self.whole.get_added_tokens_decoder()
        #: Added tokens that stand for themselves wherever they occur; texts with others are tokenised whole.
        self.plain = {t.content: k for k, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        self.odd = [t.content.encode() for k, t in added.items() if t.content not in self.plain]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.plain, key=len, reverse=True))) + ")") if self.plain else None
        self.memo = Memo(most)

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def unit(self, data: bytes) -> list[int]:
        text = data.decode()
        return self.fast(text) if self.fast and (text.isascii() or _LATIN.fullmatch(text)) else self.encode(text)

    def find(self, raw: bytes, low: list[int], high: list[int]) -> np.ndarray:
        """The unit of each stretch of bytes."""
        words = self.memo.words
        parts = [raw[a:b] for a, b in zip(low, high)]
        units = np.fromiter(map(words.get, parts, repeat(-1)), np.int64, len(parts))
        lost = np.flatnonzero(units < 0).tolist()
        if lost:
            new = list(dict.fromkeys(parts[k] for k in lost))
            if self.fast and all(map(bytes.isascii, new)):
                ids = list(map(self.fast, map(bytes.decode, new)))
            else:
                ids = [self.unit(x) for x in new]
            first = self.memo.add(ids)
            words.update(zip(new, range(first, first + len(new))))
            units[lost] = [words[parts[k]] for k in lost]
        return units

    def gap(self, gap: bytes, whole: bool) -> int:
        """The unit of white space. Before a word its last character stands alone, unless that is a space, which went to the word."""
        whole |= len(gap) == 1
        unit = self.memo.gaps.get((gap, whole))
        if unit is None:
            unit = self.memo.add([[i for part in ((gap,) if whole else (gap[:-1], gap[-1:])) for i in self.encode(part.decode())]])
            if len(gap) <= 64:
                self.memo.gaps[gap, whole] = unit
        return unit

    def group(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each of several texts without white space beyond ASCII and without added tokens."""
        if self.memo.n > self.memo.most:
            self.memo.clear()
        starts, ends, counts = C.word_spans(data, offsets)
        n, n_texts = len(starts), len(offsets) - 1
        owner = np.repeat(np.arange(n_texts), np.diff(counts))
        before = np.empty(n, np.int64)  # where the white space before the word begins
        before[1:] = ends[:-1]
        first = counts[:-1][np.diff(counts) > 0]
        before[first] = offsets[:-1][np.diff(counts) > 0]
        gap = starts - before
        spaced = np.zeros(n, bool)
        far = gap > 0
        spaced[far] = data[starts[far] - 1] == 0x20
        raw = data.tobytes()
        units = np.zeros(2 * n + n_texts, np.int64)  # for each word its gap and itself; for each text its last gap
        at = 2 * np.arange(n) + owner
        units[at + 1] = self.find(raw, (starts - spaced).tolist(), ends.tolist())
        for k in np.flatnonzero(gap - spaced > 0).tolist():
            units[at[k]] = self.gap(raw[before[k] : starts[k] - spaced[k]], bool(spaced[k]))
        tails = np.where(counts[1:] > counts[:-1], ends[np.maximum(counts[1:], 1) - 1] if n else offsets[:-1], offsets[:-1])
        for t in np.flatnonzero(tails < offsets[1:]).tolist():
            units[2 * counts[t + 1] + t] = self.gap(raw[tails[t] : offsets[t + 1]], True)
        lengths = self.memo.length[units]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.memo.ids[np.repeat(self.memo.offset[units] - total[:-1], lengths) + np.arange(total[-1])]
        bounds = total[2 * counts + np.arange(n_texts + 1)]
        return [ids[bounds[t] : bounds[t + 1]] for t in range(n_texts)]

    def one(self, text: str) -> np.ndarray:
        """Ids of a text of any kind."""
        if any(x in text.encode() for x in self.odd):
            return np.array(self.encode(text), np.uint32)
        out = [np.empty(0, np.uint32)]
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.plain:
                out.append(np.array([self.plain[part]], np.uint32))
                continue
            for piece in slices(part):
                if _ODD_SPACE.search(piece):
                    out.append(np.array(self.encode(piece), np.uint32))
                else:
                    own = np.frombuffer(piece.encode(), np.uint8)
                    out.append(self.group(own, np.array([0, len(own)]))[0])
        return np.concatenate(out)

    def texts(self, texts: C.Texts) -> Iterator[np.ndarray]:
        marks = [x.encode() for x in self.plain] + self.odd
        for a, b in texts.groups():
            data, offsets = texts.bytes_of(a, b)
            raw = data.tobytes()
            if len(raw) > C.SLICE or any(x in raw for x in marks) or _ODD_SPACE.search(raw.decode()):
                for k in range(a, b):
                    yield self.one(texts[k].decode())
            else:
                yield from self.group(data, offsets)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


PIECE = ("start", "length", "ids_crc32", "doc_tokens")


def piece_maker(path: str, ranks: str | None, window: int, end_id: int, key: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(tool.texts(C.Texts(batch["__sf_text"]))):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                rows += [(k, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            owner, *columns = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5))
            yield pa.RecordBatch.from_arrays([batch[key].take(owner), *columns], names=[key, *PIECE])
        C.release()

    return pieces


class CapacityTree:
    """A segment tree over remaining capacities: which is the least, at or above a length, that an open sequence has."""

    def __init__(self, window: int):
        self.size = C.next_pow2(window + 1)
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        k = capacity + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def pop(self, capacity: int) -> int:
        k = capacity + self.size
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.open[capacity].pop()

    def tightest(self, length: int) -> int:
        """The least capacity of at least this length, or -1."""
        k = length + self.size
        if self.count[k]:
            return length
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    tree, n = CapacityTree(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        capacity = tree.tightest(length)
        if capacity < 0:
            own, capacity, n = n, window, n + 1
        else:
            own = tree.pop(capacity)
        sequence[k], offset[k] = own, window - capacity
        if capacity > length:
            tree.push(capacity - length, own)
    return sequence, offset


def packer(window: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__sf_place")  # rows arrive in any order
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        shard = table["__sf_shard"][0].as_py()
        return table.drop_columns(["__sf_place", "__sf_shard"]).append_column("sequence_id", pa.array(2 * (sequence * shards + shard))).append_column("offset", pa.array(offset))

    return run


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, ranks: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of a document: where it starts in its document, and where it stands in its sequence.

    tokenizer: a file of a byte-level BPE vocabulary, the same on every executor; ranks: the same merges for tiktoken, or None.
    Full windows have odd sequence_ids.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    C.bounded_batches(df.sparkSession)
    own = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__sf_text"))
    schema = T.StructType([own.schema.fields[0], *(T.StructField(n, T.LongType()) for n in PIECE)])
    pieces = C.materialise(own.mapInArrow(piece_maker(tokenizer, ranks, window, end_id, key), schema))
    placed = pieces.withColumn("__sf_place", F.monotonically_increasing_id())  # of rows of a table that doesn't change
    full = placed.where(F.col("length") == window).select(F.col(f"`{key}`"), *PIECE, (2 * F.col("__sf_place") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = placed.where(F.col("length") < window)
    shards = max(1, -(-pieces.where(F.col("length") < window).count() // shard_pieces))
    dealt = rest.withColumn("__sf_shard", F.pmod(F.xxhash64("__sf_place"), F.lit(shards)))
    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return full.unionByName(dealt.groupBy("__sf_shard").applyInArrow(packer(window, shards), out))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.documents(spark, sf_dir))


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
