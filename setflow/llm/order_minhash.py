"""Document fingerprints: order MinHash, whose likeness follows edit distance rather than sets.

Method. A text's k-mers are its runs of CHARS code points (shorter at its end, so n code points give n k-mers);
equal k-mers are numbered by occurrence. Each numbered k-mer is hashed once; the hash names one of BINS bins and a
rank in it. In each bin the two k-mers of least rank are put back into text order, and the hash of that tuple is the
bin's part of the signature. A bin matches another text's only if the same k-mers occur in the same order. (One
hash split into bins stands for as many permutations.) Likeness is the share of matching bins among those that are
filled in either text; two empty texts are alike.

The next document. Rows are dealt to ranges of (key, hash of the text, a salt), so that even a key or a row that very many
rows share is spread, and sorted in them. A task goes through its range once and holds one row back, whose next one comes
after it; only the last row of each range waits for the first text of the next range. Ranges number one for each RANGE_BYTES, MOST_RANGES
at most; longer ranges are streamed all the same.

Defined cases: a null text is empty and has an empty signature; a text of any length is signed whole, in one task; a single
document is its own next; rows of equal keys follow in the order of a hash of their texts, equal rows in any; null keys come first;
keys are numbers; equal texts have equal fingerprints, whatever their keys; positions count modulo 2**26, beyond which only the
order within a tuple can change; an empty table gives an empty result; input columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C

CHARS = 5
BINS_LOG2 = 6
POSITION_BITS = 26
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 15
OUT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

_U = np.uint64
_ODD = np.array([0x9E6C63D0876A9A35, 0xB17A4F2C91D3E585, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)
_LOW = _U((1 << POSITION_BITS) - 1)
_POSITION, _BIN = _U(POSITION_BITS), _U(64 - BINS_LOG2)


def character_signature(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the hash of its tuple below the bin's number, and whether the bin is filled."""
    out, filled = np.zeros(1 << BINS_LOG2, _U), np.zeros(1 << BINS_LOG2, bool)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return out, filled
    padded = np.zeros(n + CHARS - 1, _U)  # 0 stands after the text
    padded[:n] = points
    padded[:n] += _U(1)
    kmer = padded[:n] * _ODD[0]
    for j in range(1, CHARS):
        kmer += padded[j : j + n] * _ODD[j]
    place = np.arange(n)
    x = C.mix(kmer) & ~_LOW | place.astype(_U) & _LOW
    x.sort()
    group = x >> _POSITION
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    occurrence = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(_U)
    r = C.mix(group * _ODD[1] + occurrence * _ODD[2] + _ODD[3]) & ~_LOW | x & _LOW
    r.sort()
    bins = (r >> _BIN).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    both = np.diff(np.append(head, n)) > 1
    a, b = r[head], r[np.minimum(head + 1, n - 1)]
    turn = both & ((a & _LOW) > (b & _LOW))
    first, second = np.where(turn, b, a) >> _POSITION, np.where(turn, a, b) >> _POSITION
    pair = C.mix(C.mix(first * _ODD[4] + _ODD[0]) + np.where(both, second * _ODD[3] + _ODD[2], _U(0)))
    out[bins[head]], filled[bins[head]] = (r[head] >> _BIN << _BIN) | (pair >> _U(BINS_LOG2)), True
    return out, filled


def character_likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    n = np.count_nonzero(a[1] | b[1])
    return np.count_nonzero((a[0] == b[0]) & a[1] & b[1]) / n if n else 1.0


def row_of(own: str, after: str, sig: tuple, after_sig: tuple) -> tuple:
    """The output columns of a text with these signatures of its own and of the next text."""
    half = len(own) // 2
    edited = own[: len(own) - half] + after[:half]
    changed = sig if edited == own else character_signature(edited)
    shown = (x[0][x[1]].astype(">u8").tobytes().hex() for x in (sig, changed))
    return len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), *shown, character_likeness(sig, changed), character_likeness(sig, after_sig)


KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
#: Of a range's first and last row: the number of the range and the text; else null.
ENDS = ("__sf_first_of", "__sf_last_of", "__sf_end_text")


def signer(names: list[str]):
    """Rows of a range in order; the last one's output columns stay null."""

    def batch_of(kept: list, rows: list[tuple | None], ends: list[tuple]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([k[n] for k in kept]) for n in range(len(names))]
        out = [pa.array([r[i] if r else None for r in rows], t) for i, t in enumerate(KINDS)]
        marks = [pa.array([e[i] for e in ends], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *out, *marks], names=[*names, *OUT, *ENDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = context.partitionId() if (context := TaskContext.get()) else 0
        held: tuple | None = None  # (kept columns, text, signature) of the row before
        first = True
        for batch in batches:
            kept, rows, ends = [], [], []
            for k, text in enumerate(batch["__sf_text"].to_pylist()):
                own = ([batch[n].slice(k, 1) for n in names], text, held[2] if held and held[1] == text else character_signature(text))
                if held:
                    kept.append(held[0])
                    rows.append(row_of(held[1], text, held[2], own[2]))
                    ends.append((part, None, held[1]) if first else (None, None, None))
                    first = False
                held = own
            if kept:
                yield batch_of(kept, rows, ends)
        if held:
            yield batch_of([held[0]], [None], [(part if first else None, part, held[1])])
        C.release()

    return run


def finisher(names: list[str]):
    """The last rows of ranges, with the text that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row_of(own, after, character_signature(own), character_signature(after)) for own, after in zip(batch["__sf_end_text"].to_pylist(), batch["__sf_after"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(KINDS))], names=[*names, *OUT])

    return run


def character_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", range_bytes: int = RANGE_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    C.bounded_batches(df.sparkSession)
    kept = [n for n in (keep if keep is not None else df.columns) if n.lower() not in OUT]
    own = df.select(*[F.col(f"`{n}`") for n in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__sf_text"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("__sf_key"))
    ranges = min(MOST_RANGES, max(1, -(-C.text_bytes(df, text) // range_bytes)))
    order = ("__sf_key", "__sf_hash", "__sf_salt")
    salted = own.withColumns({"__sf_hash": F.xxhash64("__sf_text"), "__sf_salt": F.monotonically_increasing_id()})
    dealt = salted.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    kinds = (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType())
    columns = [*own.schema.fields[: len(kept)], *(T.StructField(n, t) for n, t in zip(OUT, kinds))]
    marks = [T.StructField(ENDS[0], T.IntegerType()), T.StructField(ENDS[1], T.IntegerType()), T.StructField(ENDS[2], T.StringType())]
    signed = C.materialise(dealt.select(*[F.col(f"`{n}`") for n in kept], "__sf_text").mapInArrow(signer(kept), T.StructType([*columns, *marks])))
    firsts = signed.where("__sf_first_of IS NOT NULL").select(F.col("__sf_first_of").alias("range"), F.col("__sf_end_text").alias("first_text"))  # one row for each range
    following = firsts.select("range", F.lead("range").over(Window.orderBy("range")).alias("next"), F.min("range").over(Window.partitionBy(F.lit(0))).alias("least"))
    following = following.select(F.col("range").alias("__sf_range"), F.coalesce("next", "least").alias("__sf_next"))
    after = firsts.select(F.col("range").alias("__sf_of"), F.col("first_text").alias("__sf_after"))
    last = signed.where("__sf_last_of IS NOT NULL").select(*[F.col(f"`{n}`") for n in kept], "__sf_last_of", "__sf_end_text")
    last = last.join(following, F.col("__sf_last_of") == F.col("__sf_range")).join(after, F.col("__sf_next") == F.col("__sf_of"))
    done = last.select(*[F.col(f"`{n}`") for n in kept], "__sf_end_text", "__sf_after").mapInArrow(finisher(kept), T.StructType(columns))
    return signed.where("__sf_last_of IS NULL").drop(*ENDS).unionByName(done)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return character_fingerprints(C.documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


QUERIES = {"op10_order_minhash": op10_order_minhash}
ORACLE: dict[str, str] = {}
