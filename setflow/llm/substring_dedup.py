"""Substring dedup: passages of `window` words that occur more than once are removed from every text.

Method. Rabin-Karp hashes (64 bits) of every window of consecutive words are counted in Spark: documents are
dealt to blocks, each block packs its distinct window hashes by bucket, each bucket finds the hashes that occur
more than once over all blocks and replies to the blocks that hold them. The windows that this finds are counted again in the
same way by a second hash (of other word hashes and another base), and a window is repeated if both say so. A block then marks
all its repeated windows; overlapping windows merge into maximal intervals, whose words are removed. Windows are judged on
the input. Copies within a block are counted before the shuffle, so a hash sends each bucket one value a block,
however many documents share it. A window is removed by mistake only if each of its two 64-bit hashes is that of some other
window: of n windows, r of them repeated, about n * (n / 2**64) * (r / 2**64) (1e-9 at 30 GB, 5 of 1.7e13 at 100 TB).

Defined cases: a null text has no words (kept text ''), and so has a text of white space; texts shorter than the window keep
all words; a text of any length is hashed slice by slice, in one task; equal windows are all removed, whichever comes
first; repeated rows are judged like other documents, so both lose their windows, and rows equal in all columns meet in one
block; an empty table gives an empty result; columns of the input named like an output column are replaced, all others
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C

WINDOW = 35
#: Bytes of text in a block, and packed bytes of hashes in a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_HASHES = 1 << 20
#: Partitions of the shuffle of texts; beyond, a task has several blocks, one after another.
MOST_PARTITIONS = 1 << 15
OUT = ("n_words", "n_removed", "kept_text")
BLOCK = "__sf_block"


def window_hashes(texts: C.Texts, a: int, b: int, window: int):
    """(data, word starts, word ends, words before each text, starts of windows, their hashes) of texts a to b."""
    data, offsets = texts.bytes_of(a, b)
    starts, ends, counts = C.word_spans(data, offsets)
    hashes = C.rolling(C.word_hashes(data, starts, ends), window, C._BASE["word"][0])
    at = np.flatnonzero(C.window_mask(counts, window))
    return data, starts, ends, counts, at, hashes[at]


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at these words, independent of window_hashes."""
    return C.rolling(C.word_hashes(data, starts, ends, C._BASE["byte"][1]), window, C._BASE["word"][1])[at]


def rotate(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The low bits, which name the bucket, become the high bits."""
    return hashes if bits == 0 else (hashes << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))


def packed_rows(block: int, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """(bucket, block, several, packed) of a block's hashes, which are rotated."""
    values, n = np.unique(hashes, return_counts=True)
    for several in (False, True):
        own = values[(n > 1) == several]
        low = (np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1) if bits else np.uint64(C.MASK)
        bucket = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()  # only the buckets that occur
        for a, b in zip(edge, [*edge[1:], len(own)]):
            yield int(bucket[a]), block, several, C.pack(own[a:b] & low)


PACKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("several", pa.bool_()), ("hashes", pa.binary())])


def emitter(text: str, window: int, bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            texts, blocks = C.Texts(batch[text]), batch[BLOCK].to_numpy(zero_copy_only=False)
            for a, b in texts.groups():
                _, _, _, counts, at, hashes = window_hashes(texts, a, b, window)
                owner = blocks[a:b][np.searchsorted(counts, at, side="right") - 1]
                hashes = rotate(hashes, bits)
                for block in np.unique(owner):
                    found.setdefault(int(block), []).append(hashes[owner == block])
        for block in list(found):
            rows = list(packed_rows(block, np.concatenate(found.pop(block)), bits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PACKED.types)], schema=PACKED)
        C.release()

    return emit


def replies(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its hashes occur more than once over all blocks."""
    several = table["several"].to_pylist()
    sets = [C.unpack(x) for x in table["hashes"].to_pylist()]
    values, n = np.unique(np.concatenate([y for x, s in zip(sets, several) for y in ([x, x] if s else [x])]), return_counts=True)
    repeated = values[n > 1]
    rows = []
    for bucket, block, own in zip(table["bucket"].to_pylist(), table["block"].to_pylist(), sets):
        got = own[C.member(own, repeated)]
        if len(got):
            rows.append((bucket, block, C.pack(got)))
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def union_of(sets: pa.Table, bits: int) -> np.ndarray:
    """The hashes, in order and rotated, of all buckets of a block."""
    shift = np.uint64(64 - bits)
    parts = [C.unpack(h) | ((np.uint64(b) << shift) if bits else np.uint64(0)) for b, h in zip(sets["bucket"].to_pylist(), sets["hashes"].to_pylist())]
    return np.sort(np.concatenate([np.empty(0, np.uint64), *parts]))


def verifier(text: str, window: int, bits: int):
    """Of one block: the second hashes of windows whose first is repeated, packed."""

    def run(docs: pa.Table, sets: pa.Table) -> pa.Table:
        repeated, found = union_of(sets, bits), [np.empty(0, np.uint64)]
        texts = C.Texts(docs[text])
        for a, b in texts.groups() if len(repeated) else ():
            data, starts, ends, _, at, hashes = window_hashes(texts, a, b, window)
            at = at[C.member(rotate(hashes, bits), repeated)]
            if len(at):
                found.append(rotate(second_hashes(data, starts, ends, window, at), bits))
        rows = list(packed_rows(docs[BLOCK][0].as_py() if docs.num_rows else 0, np.concatenate(found), bits))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, PACKED.types)], schema=PACKED)

    return run


def remover(text: str, window: int, bits: int, schema: pa.Schema):
    """Of one block: its documents without the words that repeated windows cover."""

    def remove(docs: pa.Table, sets: pa.Table) -> pa.Table:
        first, second = (union_of(sets.filter(pc.equal(sets["pass"], k)), bits) for k in (1, 2))
        texts = C.Texts(docs[text])
        n_words, n_removed, kept = [], [], []
        for a, b in texts.groups():
            data, starts, ends, counts, at, hashes = window_hashes(texts, a, b, window)
            at = at[C.member(rotate(hashes, bits), first)]
            if len(at):
                at = at[C.member(rotate(second_hashes(data, starts, ends, window, at), bits), second)]
            gone = C.covered(at, window, len(starts))
            total = np.concatenate([[0], np.cumsum(gone)])
            for k in range(b - a):
                w0, w1 = int(counts[k]), int(counts[k + 1])
                n_words.append(w1 - w0)
                n_removed.append(int(total[w1] - total[w0]))
                if n_removed[-1] == 0:
                    kept.append(b" ".join(texts[a + k].split()))
                else:
                    stay = np.flatnonzero(~gone[w0:w1]) + w0
                    kept.append(b" ".join([data[s:e].tobytes() for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]))
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        C.release()
        return pa.Table.from_arrays([out[name] if name in out else docs[name].cast(schema.field(i).type) for i, name in enumerate(schema.names)], schema=schema)

    return remove


def in_blocks(df: DataFrame, text: str, total: int, block_bytes: int) -> tuple[DataFrame, int]:
    """df dealt to blocks of about block_bytes by a hash of the whole row; the number of blocks."""
    blocks = max(1, -(-total // block_bytes))
    whole = df if df.schema[text].dataType == T.StringType() else df.withColumn(text, F.col(f"`{text}`").cast("string"))
    keys = [F.col(f"`{f.name}`") for f in whole.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return whole.withColumn(BLOCK, F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition(min(blocks, MOST_PARTITIONS), BLOCK), blocks


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """df with n_words, n_removed and kept_text: the words kept, joined by one space."""
    from pyspark.sql.pandas.types import to_arrow_schema

    C.bounded_batches(df.sparkSession)
    total = C.text_bytes(df, text)
    blocks, _ = in_blocks(C.without(df, *OUT), text, total, block_bytes)
    bits = int(np.log2(C.next_pow2(total / 6 / bucket_hashes)))
    packed = blocks.mapInArrow(emitter(text, window, bits), "bucket int, block int, several boolean, hashes binary")
    sets = packed.groupBy("bucket").applyInArrow(replies, "bucket int, block int, hashes binary")
    by_block = blocks.groupBy(BLOCK)
    again = by_block.cogroup(sets.groupBy("block")).applyInArrow(verifier(text, window, bits), "bucket int, block int, several boolean, hashes binary")
    verified = again.groupBy("bucket").applyInArrow(replies, "bucket int, block int, hashes binary")
    both = sets.withColumn("pass", F.lit(1)).union(verified.withColumn("pass", F.lit(2)))
    names = [f for f in blocks.schema.fields if f.name != BLOCK]
    out = T.StructType([*names, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    schema = to_arrow_schema(out)
    return by_block.cogroup(both.groupBy("block")).applyInArrow(remover(text, window, bits, schema), out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE = {
    "op3_substring_dedup": rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS words FROM documents
), windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + {WINDOW - 1}], ' ') AS passage
  FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS place FROM texts WHERE len(words) >= {WINDOW})
), repeated AS (
  SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY passage) AS n FROM windows) WHERE n > 1
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), marked AS (
  SELECT e.doc_id, e.word, e.place, max(r.place) OVER (PARTITION BY e.doc_id ORDER BY e.place) AS last
  FROM each e LEFT JOIN repeated r ON e.doc_id = r.doc_id AND e.place = r.place
), kept AS (
  SELECT doc_id, count(*) FILTER (last > place - {WINDOW}) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (last IS NULL OR last <= place - {WINDOW}) AS kept_text
  FROM marked GROUP BY doc_id
)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id"""
}
