"""Suffix-array dedup: bytes in strings of `window` bytes that occur more than once are removed from every text.

Method. The suffix order of a whole corpus can't be cut by documents, so windows first choose where they meet: a
window's anchor is the least Rabin-Karp hash of its 64-byte strings (equal windows have equal anchors, at equal
places). Windows in a row that share an anchor form a stretch. Anchors that occur once are dropped (counted in Spark as
packed hashes). Equal stretches of the others are merged before they move: a stretch that occurs several times is repeated
as it is, and one copy of it stands for all. An anchor's different stretches are handed to its shard, which builds their
collection's Burrows-Wheeler transform and common prefixes column by column, one symbol of each stretch a round, over
symbols of eight bytes counted from the anchor, on sequential tapes (files in the shared folder beyond TAPE_BYTES). Suffixes
that share 49 symbols form classes; a window is its class and the eight bytes around it, so equal windows are those
that agree in both.

Hot anchors. An anchor of more than HOT different stretches is cut: windows that reach far before the anchor get a key of the
anchor with half of the bytes that they may have before it, all others a key of the anchor with half of those after it.
Every cut halves what is left of the window outside its key, so nine cuts at most leave windows that are equal. Equal
windows are cut alike; no window is dropped.

Symbols of eight bytes rather than one cut the rounds from about 730 to 92 and the work, which grows with the
square of the rounds, to a sixtieth. Matches never cross documents, overlaps count, windows are judged on the input.

Defined cases: a null text is empty; texts shorter than the window keep all bytes; a text of any length is searched
slice by slice, in one task; equal windows are all removed, whichever comes first; repeated rows are judged like other
documents, so both lose their windows, and rows equal in all columns meet in one block; an empty table gives an empty result;
input columns named like an output column are replaced, all others are kept. Stretches of one anchor count as equal with the
chance that 128-bit digests are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C
from setflow.llm.collection_bwt import TAPE_BYTES, Tapes, collection_bwt
from setflow.llm.substring_dedup import BLOCK, in_blocks, packed_rows, replies, rotate, union_of

WINDOW = 400
ANCHOR = 64
SYMBOL = 8
BLOCK_BYTES = 8 << 20
BUCKET_HASHES = 1 << 20
SHARD_BYTES = 8 << 20
#: Different stretches of one anchor beyond which it is cut.
HOT = 32768
OUT = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
_POSITION = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, its place, first window, end of windows) of all stretches of texts one after another."""
    total = len(data) - window + 1
    if total <= 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    good = C.window_mask(offsets, window)
    found = []
    for a in range(0, total, C.SLICE):
        b = min(total, a + C.SLICE)
        hashes = C.rolling(data[a : b + window - 1], ANCHOR, C._BASE["byte"][1])
        least = sliding_min((hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64), window - ANCHOR + 1)
        at = np.flatnonzero(good[a:b])
        if not len(at):
            continue
        place = (least[at] & _POSITION).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1), [True]]))
        found.append((hashes[place[edge[:-1]]], place[edge[:-1]] + a, at[edge[:-1]] + a, at[edge[1:] - 1] + a + 1))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)


def anchor_emitter(text: str, window: int, bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            texts, blocks = C.Texts(batch[text]), batch[BLOCK].to_numpy(zero_copy_only=False)
            for a, b in texts.groups():
                data, offsets = texts.bytes_of(a, b)
                anchors, place, _, _ = stretches(data, offsets, window)
                owner = blocks[a:b][np.searchsorted(offsets, place, side="right") - 1]
                for block in np.unique(owner):
                    found.setdefault(int(block), []).append(rotate(anchors[owner == block], bits))
        for block in list(found):
            rows = list(packed_rows(block, np.concatenate(found.pop(block)), bits))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "block", "several", "hashes"])
        C.release()

    return emit


Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cut_stretches(view: memoryview, own: Stretches, window: int) -> Stretches:
    """Stretches (key, low, high, start, end) whose windows share the bytes low to high, cut into those that share more."""
    import xxhash

    _, low, high, start, end = own
    rest = window - (high - low)
    half = np.maximum(1, rest // 2)
    edge = low - half + 1  # the first window that doesn't have that many bytes before
    parts = []
    for a, b, x, y in ((low - half, high, start, np.minimum(end, edge)), (low, high + rest - half + 1, np.maximum(start, edge), end)):
        some = np.flatnonzero((x < y) & (rest > 0))
        keys = np.array([xxhash.xxh3_64_intdigest(view[p:q]) for p, q in zip(a[some].tolist(), b[some].tolist())], np.uint64)
        parts.append((keys, a[some], b[some], x[some], y[some]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def found_stretches(texts: C.Texts, window: int, wanted, hot: list[np.ndarray], newest: bool = False, only: np.ndarray | None = None):
    """Over groups of texts: (first text, end, data, offsets, key, low, start, end, digests) of the stretches of wanted anchors.

    hot: for each cut the keys that it cuts; newest: only what the last cut leaves; only: just the stretches of these keys.
    """
    import xxhash

    for a, b in texts.groups():
        data, offsets = texts.bytes_of(a, b)
        view = memoryview(np.ascontiguousarray(data))
        anchors, place, start, end = stretches(data, offsets, window)
        own = np.flatnonzero(wanted(anchors))
        now = (anchors[own], place[own], place[own] + ANCHOR, start[own], end[own])
        parts = []
        for keys in hot:
            cut = C.member(now[0], keys)
            parts.append(tuple(x[~cut] for x in now))
            now = cut_stretches(view, tuple(x[cut] for x in now), window)
        key, low, _, start, end = now if newest else tuple(np.concatenate(x) for x in zip(*parts, now))
        if only is not None:
            own = np.flatnonzero(C.member(key, only))
            key, low, start, end = key[own], low[own], start[own], end[own]
        raw = b"".join([xxhash.xxh3_128_digest(view[s : e + window - 1]) for s, e in zip(start.tolist(), end.tolist())])
        yield a, b, data, offsets, key, low, start, end, np.frombuffer(raw, "<i8").reshape(-1, 2)


#: What a block is told. kind: -1 - k for a key that is cut the (k + 1)-th time, ASK for a copy, ASK + 1 if that stretch is repeated, SPAN for windows to remove.
TOLD = "block int, kind int, anchor long, d1 long, d2 long, first int, last int"
ASK, SPAN = 2, 4


def hot_keys(told: pa.Table) -> list[np.ndarray]:
    kind, key = told["kind"].to_numpy(), told["anchor"].to_numpy().view(np.uint64)
    return [np.sort(key[kind == -1 - k]) for k in range(-int(kind.min(initial=0)))]


DIGESTS = "block int, anchor long, d1 long, d2 long, n long"


def digester(text: str, window: int, bits: int | None):
    """Of one block: its stretches of repeated anchors (or, without bits, those that the last cut leaves), each different one once with its number."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        parts = [np.empty((0, 3), np.int64)]
        if told.num_rows and docs.num_rows:
            if bits is not None:
                repeated, hot = union_of(told, bits), []
                wanted = lambda x: C.member(rotate(x, bits), repeated)
            else:
                hot = hot_keys(told)
                wanted = lambda x: C.member(x, hot[0])
            parts += [np.column_stack([x[4].view(np.int64), x[8]]) for x in found_stretches(C.Texts(docs[text]), window, wanted, hot, newest=True)]
        keys, n = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        block = docs[BLOCK][0].as_py() if docs.num_rows else 0
        return pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "anchor": pa.array(keys[:, 0]), "d1": pa.array(keys[:, 1]), "d2": pa.array(keys[:, 2]), "n": pa.array(n.astype(np.int64))})

    return run


COPIES = "block int, anchor long, d1 long, d2 long, kind int, place int, bytes binary"


def hander(text: str, window: int):
    """Of one block: the bytes of the stretches that it was asked for."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        hot = hot_keys(told)
        asked = told.filter(pc.greater(told["kind"], 0))
        wanted = dict(zip(zip(*(asked[c].to_pylist() for c in ("anchor", "d1", "d2"))), asked["kind"].to_pylist()))
        rows: list[tuple] = []
        if wanted and docs.num_rows:
            block = docs[BLOCK][0].as_py()
            only = np.unique(asked["anchor"].to_numpy().view(np.uint64))
            first = np.union1d(only, hot[0]) if hot else only
            for _, _, data, _, key, low, start, end, digest in found_stretches(C.Texts(docs[text]), window, lambda x: C.member(x, first), hot, only=only):
                for k, name in enumerate(zip(key.view(np.int64).tolist(), *digest.T.tolist())):
                    if (kind := wanted.pop(name, None)) is not None:
                        rows.append((block, *name, kind, int(low[k] - start[k]), data[start[k] : end[k] + window - 1].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "anchor", "d1", "d2", "kind", "place", "bytes"])

    return run


def shard_searcher(window: int, folder: str, tape_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one shard: runs of windows (first to last, counted from a stretch's first) that another stretch of the key has too."""
        texts = [np.frombuffer(x, np.uint8) for x in table["bytes"].to_pylist()]
        lead = table["place"].to_numpy().astype(np.int64) % SYMBOL  # bytes before the first symbol
        _, group = np.unique(table["anchor"].to_numpy(), return_inverse=True)
        symbols = [x[p : p + (len(x) - p) // SYMBOL * SYMBOL].view("<u8") for x, p in zip(texts, lead.tolist())]
        _, code = np.unique(np.concatenate([np.empty(0, np.uint64), *symbols]), return_inverse=True)
        size = np.array([len(s) for s in symbols], np.int64)
        cuts = np.concatenate([[0], np.cumsum(size)])
        need = (window - SYMBOL) // SYMBOL
        classes = np.zeros(cuts[-1] + len(texts), np.int32)  # by string and symbol
        tapes, now = Tapes(folder, tape_bytes), 0
        try:
            for _, string, length, lcp in collection_bwt([code[a:b] for a, b in zip(cuts, cuts[1:])], group, tapes):
                kind = now + np.cumsum(lcp < need)
                classes[cuts[string] + string + size[string] - length] = kind
                now = int(kind[-1])
        finally:
            tapes.close()
        length = np.array([len(x) for x in texts], np.int64)
        flat = np.concatenate(texts)
        text_at = np.cumsum(length) - length
        n_windows = length - window + 1
        window_at = np.concatenate([[0], np.cumsum(n_windows)])
        hit = np.zeros(window_at[-1], bool)
        for before in range(SYMBOL):  # windows with so many bytes before their first whole symbol
            start = (lead - before) % SYMBOL
            n = np.maximum(0, -(-(n_windows - start) // SYMBOL))
            owner = np.repeat(np.arange(len(texts)), n)
            at = start[owner] + SYMBOL * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
            window_class = classes[cuts[owner] + owner + (at + before - lead[owner]) // SYMBOL]
            base = text_at[owner] + at
            rest = np.zeros((len(owner), SYMBOL), np.uint8)
            for k in range(SYMBOL):  # the bytes before the symbols, then those after them
                rest[:, k] = flat[base + (k if k < before else window - SYMBOL + k)]
            around = rest.view("<u8").ravel()
            order = np.lexsort((around, window_class))
            same = (window_class[order[1:]] == window_class[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
            place = window_at[owner] + at
            hit[place[order[1:][same]]] = True
            hit[place[order[:-1][same]]] = True
        hit &= ~np.repeat(table["kind"].to_numpy() == ASK + 1, n_windows)  # these go whole
        s, e = C.runs(hit, window_at)
        own = np.searchsorted(window_at, s, side="right") - 1
        names = ("anchor", "d1", "d2")
        out = {"block": pa.array(table["block"].to_numpy()[own].astype(np.int32)), "kind": pa.array(np.full(len(own), SPAN, np.int32))}
        out |= {n: pa.array(table[n].to_numpy()[own]) for n in names}
        C.release()
        return pa.table(out | {"first": pa.array((s - window_at[own]).astype(np.int32)), "last": pa.array((e - 1 - window_at[own]).astype(np.int32))})

    return run


def remover(text: str, window: int, schema: pa.Schema):
    """Of one block: its documents without the bytes that repeated windows cover."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        hot = hot_keys(told)
        found = told.filter(pc.equal(told["kind"], SPAN))
        spans: dict[tuple, list[tuple[int, int]]] = {}
        for *name, first, last in zip(*(found[c].to_pylist() for c in ("anchor", "d1", "d2", "first", "last"))):
            spans.setdefault(tuple(name), []).append((first, last))
        only = np.unique(found["anchor"].to_numpy().view(np.uint64))
        level0 = np.union1d(only, hot[0]) if hot else only
        texts = C.Texts(docs[text])
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for a, b, data, offsets, key, _, start, end, digest in found_stretches(texts, window, lambda x: C.member(x, level0), hot, only=only):
            steps = np.zeros(len(data) + 1, np.int32)
            on, off = [], []
            for s, e, name in zip(start.tolist(), end.tolist(), zip(key.view(np.int64).tolist(), *digest.T.tolist())):
                for first, last in spans.get(name, ()):
                    on.append(s + first)
                    off.append((s + last if last >= 0 else e - 1) + window)
            np.add.at(steps, np.array(on, np.int64), 1)
            np.add.at(steps, np.array(off, np.int64), -1)
            gone = np.cumsum(steps[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            s, _ = C.runs(gone, offsets)
            n_bytes += np.diff(offsets).tolist()
            n_removed += np.diff(total[offsets]).tolist()
            n_spans += np.diff(np.searchsorted(s, offsets)).tolist()
            for k in range(b - a):
                part = data[offsets[k] : offsets[k + 1]]
                kept.append((part[~gone[offsets[k] : offsets[k + 1]]] if n_removed[a + k] else part).tobytes())
        C.release()
        out = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_bytes": pa.array(kept, pa.binary())}
        return pa.Table.from_arrays([out[name] if name in out else docs[name].cast(schema.field(i).type) for i, name in enumerate(schema.names)], schema=schema)

    return run


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_hashes: int = BUCKET_HASHES, shard_bytes: int = SHARD_BYTES, hot: int = HOT, tape_bytes: int = TAPE_BYTES) -> DataFrame:
    """df with n_bytes, n_removed, n_spans and kept_bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    C.bounded_batches(df.sparkSession)
    total = C.text_bytes(df, text)
    blocks, _ = in_blocks(C.without(df, *OUT), text, total, block_bytes)
    bits = int(np.log2(C.next_pow2(total / 100 / bucket_hashes)))
    packed = blocks.mapInArrow(anchor_emitter(text, window, bits), "bucket int, block int, several boolean, hashes binary")
    sets = packed.groupBy("bucket").applyInArrow(replies, "bucket int, block int, hashes binary")
    by_block = blocks.groupBy(BLOCK)
    digests = C.materialise(by_block.cogroup(sets.groupBy("block")).applyInArrow(digester(text, window, bits), DIGESTS))
    name = ["anchor", "d1", "d2"]
    told = [F.lit(0).cast("int").alias("first"), F.lit(-1).cast("int").alias("last")]
    whole, asked, cuts = [], [], []
    while True:
        pairs = digests.groupBy(*name).agg(F.sum("n").alias("n"), F.min("block").alias("block"))
        counts = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).withColumnRenamed("anchor", "of")
        judged = C.materialise(pairs.join(counts, F.col("anchor") == F.col("of")).where("n > 1 OR different > 1").drop("of"))
        cool = judged.where(F.col("different") <= hot)
        several = cool.where("n > 1").select(*[F.col(c).alias(f"of_{c}") for c in name])
        whole.append(digests.join(several, [F.col(c) == F.col(f"of_{c}") for c in name]).select("block", F.lit(SPAN).alias("kind"), *name, *told))
        asked.append(cool.where("different > 1").select("block", F.when(F.col("n") > 1, ASK + 1).otherwise(ASK).alias("kind"), *name, *told))
        large = C.materialise(judged.where(F.col("different") > hot).select(F.col("anchor").alias("of")).distinct())
        again = large.limit(1).count() > 0
        C.free_shuffles(df.sparkSession)  # of the texts, which the next query deals again
        if not again:
            break
        held = digests.join(large, F.col("anchor") == F.col("of")).select("block", F.lit(-1 - len(cuts)).alias("kind"), "anchor").distinct()
        cuts.append(C.materialise(held.select("block", "kind", "anchor", F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), *told)))
        digests = C.materialise(by_block.cogroup(reduce(DataFrame.unionByName, cuts).groupBy("block")).applyInArrow(digester(text, window, None), DIGESTS))
    copies = by_block.cogroup(reduce(DataFrame.unionByName, asked + cuts).groupBy("block")).applyInArrow(hander(text, window), COPIES)
    shards = max(1, total // shard_bytes)
    partial = copies.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards))).applyInArrow(shard_searcher(window, C.shared_dir(df.sparkSession), tape_bytes), TOLD)
    found = reduce(DataFrame.unionByName, [partial, *whole, *cuts])
    out = T.StructType([f for f in blocks.schema.fields if f.name != BLOCK] + [T.StructField(n, T.LongType()) for n in OUT[:3]] + [T.StructField(OUT[3], T.BinaryType())])
    return by_block.cogroup(found.groupBy("block")).applyInArrow(remover(text, window, to_arrow_schema(out)), out)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE: dict[str, str] = {}
