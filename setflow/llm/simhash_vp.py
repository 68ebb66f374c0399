"""SimHash near-dedup: all pairs of 64-bit fingerprints at a small Hamming distance, and their components.

Method. Distinct fingerprints are dealt to overlapping shards by Hamming distances and searched with vantage-point trees.

Shards. The distance to one vantage point concentrates (mean 32, deviation 4) at the scale of the radius 4, so
cutting the whole space by it leaves most points within the radius of every boundary. Fingerprints are therefore
dealt by distances within fields of bits: the 64 bits form m fields; two fingerprints at distance 4 or less agree in
m - 4 fields at least. In each choice of m - 4 fields some bits of each (the distances to as many unit vectors) name the
shard; a fingerprint stands in all C(m, 4) shards, and every pair meets in one. As many bits are taken as leave SHARD_MEAN
points in a shard of random fingerprints; m grows where the fields are too short for that. A shard of over SHARD_ROWS points
is dealt again in the same way by the bits in which its own points differ, as often as needed.

Trees. All shards of a bucket grow their trees side by side, level by level. A cell's first point is its vantage point; the
median distance to it cuts the cell in two. A pair over the cut needs both points within the radius of it
(triangle inequality): points of the inner side that are that near visit the outer side, and a visitor goes down only
those sides that the bound leaves open. Cells of LEAF points or fewer are compared with their visitors. Links are united as they
are found, and a cell whose points and visitors are united already is left out: only components are returned.

Defined cases: no words (null, empty): fingerprint zero, linked like any other; a text of any length is hashed whole, in
one task; rows of one key are one node; a null key gets its own fingerprint and no component unless its fingerprint has
a key; keys of any type that has an order; equal fingerprints are one point, however many rows have them; an empty table gives
an empty result; input columns named like an output column (print, component_id) are replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C
from setflow.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Points that a shard holds on average, and those beyond which a shard is dealt again.
SHARD_MEAN = 128
SHARD_ROWS = 8192
#: Rows of many shards that one Python call takes, and of cells that are cut at once.
BUCKET_ROWS = 25_000
BATCH = 1 << 20
LEAF = 8
FLAT = 256

_U = np.uint64
_LANES = _U(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    pad = np.zeros(-(-n // 255) * 255, _U)
    pad[:n] = hashes
    pad = pad.reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    for k in range(8):
        counts[k] = ((pad >> _U(k)) & _LANES).sum(axis=1, dtype=_U).view(np.uint8).reshape(-1, 8).sum(axis=0)
    return sum(1 << (8 * byte + k) for k in range(8) for byte in range(8) if 2 * counts[k, byte] > n)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), _U, n)
    return majority(hashes)


def fingerprinter(text: str, size: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.Texts(batch[text])
            prints = np.array([fingerprint(texts[k], size, seed) for k in range(texts.n)], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + [pa.array(prints)], names=[*names, "print"])
        C.release()

    return run


def with_prints(df: DataFrame, text: str = "text", size: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df, and the fingerprint as a signed long `print`."""
    C.bounded_batches(df.sparkSession)
    names = [n for n in (keep if keep is not None else df.columns) if n.lower() != "print"]
    own = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias("__sf_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("print", T.LongType())])
    return own.mapInArrow(fingerprinter("__sf_text", size, seed, names), schema)


# --- search within a shard ------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits points differ; a point is a word, or a row of words."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class Components:
    """Labels of points; a label is the least point of what has been united."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                new = self.label[self.label]
                if (new == self.label).all():
                    break
                self.label = new


@dataclass
class Work:
    """What a search did: points compared with a vantage point, points compared in leaves, and pairs of points in shards."""

    vantage: int = 0
    leaf: int = 0
    pairs: int = 0
    levels: int = 0


def leaves(points: np.ndarray, cell: np.ndarray, own: np.ndarray, home: np.ndarray, radius: int, found: Components, work: Work) -> None:
    """Compare small cells: visitors with homes, homes with the homes before them. Entries are in order of cells, homes first."""
    if not len(own):
        return
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    first = np.repeat(edge, np.diff(np.append(edge, len(cell))))
    homes = np.add.reduceat(home, edge, dtype=np.int64)[np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]]))]
    place = np.arange(len(cell)) - first
    for k in range(int(homes.max())):  # with the k-th home of each cell
        at = np.flatnonzero((homes > k) & (place > k))
        other = own[first[at] + k]
        work.leaf += len(at)
        near = distances(points[own[at]], points[other]) <= radius
        found.unite(own[at[near]], other[near])


def compare_all(points: np.ndarray, homes: np.ndarray, visitors: np.ndarray, radius: int, found: Components, work: Work) -> None:
    """Compare a large cell: visitors with homes, homes with homes; what is near a first home is one group, whose pairs are left out."""

    def against(own: np.ndarray, others: np.ndarray) -> None:
        work.leaf += len(own) * len(others)
        for a in range(0, len(own), 256):
            for b in range(0, len(others), 4096):
                i, j = np.nonzero(np.bitwise_count(points[own[a : a + 256], None] ^ points[None, others[b : b + 4096]]).sum(axis=2, dtype=np.int32) <= radius)
                found.unite(own[a : a + 256][i], others[b : b + 4096][j])

    against(visitors, homes)
    while len(homes) > 1:
        work.vantage += len(homes)
        group = distances(points[homes], points[homes[:1]]) <= radius
        members, homes = homes[group], homes[~group]
        found.unite(members, np.full(len(members), members[0]))
        against(homes, members)


def best_cuts(cell: np.ndarray, d: np.ndarray, start: np.ndarray, cut: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each cell the distance beyond which the triangle bound leaves out most pairs, or cut where that is under a 32nd; where it isn't).

    cell, d: the homes in order, cells numbered from 0; start: the first of each cell.
    """
    count = np.diff(np.append(start, len(cell)))
    span = int(d.max()) + 2
    place = cell * span + d
    after = np.searchsorted(place, place, side="right") - start[cell]  # homes up to this distance
    apart = np.searchsorted(place, cell * span + np.maximum(d - radius, -1), side="right") - start[cell]  # those that needn't look beyond it
    left_out = np.maximum(apart - 1, 0) * (count[cell] - after)  # the vantage point has met all
    most = np.maximum.reduceat(left_out, start)
    first = np.flatnonzero(left_out == most[cell])
    first = first[np.unique(cell[first], return_index=True)[1]]
    parted = 64 * most >= count * count
    return np.where(parted, d[first], cut), parted


def vantage_point_search(points: np.ndarray, shard: np.ndarray, radius: int, best: bool = False, batch: int = BATCH) -> tuple[np.ndarray, Work]:
    """(the least point that each point is linked with, what it took), over pairs of points of one shard.

    points are distinct within a shard; one that stands in several shards is a point in each. shard: numbers in order.
    best: points are rows of words; cut where the bound leaves out most, not always at the median. Where it leaves out next to nothing
    in a cell of over FLAT homes, but many are near the vantage point, they are one group, and the cell is compared by groups.
    """
    found, work = Components(len(points)), Work()
    size = np.bincount(shard) if len(shard) else np.zeros(0, np.int64)
    work.pairs = int((size * (size - 1) // 2).sum())
    todo = [(shard.astype(np.int64), np.arange(len(points)), np.ones(len(points), bool), 0)]
    while todo:
        cell, own, home, level = todo.pop()
        work.levels = max(work.levels, level)
        order = np.lexsort((~home, cell))
        cell, own, home = cell[order], own[order], home[order]
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        if not len(edge):
            continue
        if len(cell) > batch and len(edge) > 1:  # half of the cells at a time
            half = edge[max(1, int(np.searchsorted(edge, len(cell) // 2, side="right")) - 1)]
            todo += [(cell[half:], own[half:], home[half:], level), (cell[:half], own[:half], home[:half], level)]
            continue
        number = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(cell))))
        homes = np.add.reduceat(home, edge, dtype=np.int64)
        label = found.label[own]
        open_ = (homes > 0) & (np.maximum.reduceat(label, edge) != np.minimum.reduceat(label, edge))
        small = (open_ & (homes <= LEAF))[number]
        leaves(points, number[small], own[small], home[small], radius, found, work)
        large = (open_ & (homes > LEAF))[number]
        if not large.any():
            continue
        vantage = own[edge][number[large]]  # the first home of the cell
        number, own, home = number[large], own[large], home[large]
        d = distances(points[own], points[vantage]).astype(np.int64)
        work.vantage += len(d)
        near = d <= radius
        found.unite(own[near], vantage[near])
        # the median distance of the homes of each cell, or one less where no home is beyond it
        held = np.flatnonzero(home)
        by = np.lexsort((d[held], number[held]))
        kept, start = np.unique(number[held][by], return_index=True)
        count = np.diff(np.append(start, len(held)))
        sorted_d = d[held][by]
        cut = sorted_d[start + (count - 1) // 2]
        cut -= cut == sorted_d[start + count - 1]
        if best:
            cut, parted = best_cuts(np.repeat(np.arange(len(start)), count), sorted_d, start, cut, radius)
            ball = np.add.reduceat(sorted_d <= radius, start, dtype=np.int64)
            flat = np.isin(number, kept[~parted & (count > FLAT) & (32 * ball > count)])
            for k in np.unique(number[flat]).tolist():
                here = number == k
                compare_all(points, own[here & home], own[here & ~home], radius, found, work)
            number, own, home, d = number[~flat], own[~flat], home[~flat], d[~flat]
            if not len(number):
                continue
        at = np.searchsorted(kept, number)
        far = d - cut[at]  # inside where 0 or less
        inner = np.flatnonzero(np.where(home, far <= 0, far <= radius))
        outer = np.flatnonzero(np.where(home, far > 0, far > -radius) | (home & (far <= 0) & (far > -radius)))
        todo.append((np.concatenate([2 * at[inner], 2 * at[outer] + 1]), np.concatenate([own[inner], own[outer]]), np.concatenate([home[inner], home[outer] & (far[outer] > 0)]), level + 1))
    return found.label, work


def searcher(radius: int):
    def run(table: pa.Table) -> pa.Table:
        """Of all shards of a bucket: every linked point with the least of its component there."""
        shard, points = table["shard"].to_numpy(), table["print"].to_numpy().view(_U)
        order = np.lexsort((points, shard))
        shard, points = shard[order], points[order]
        new = np.concatenate([[True], shard[1:] != shard[:-1]])
        label, _ = vantage_point_search(points, np.cumsum(new) - 1, radius)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(points[own].view(np.int64)), "b": pa.array(points[label[own]].view(np.int64))}).group_by(["a", "b"]).aggregate([])

    return run


# --- shards -----------------------------------------------------------------------------------------


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shard_masks(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> list[int]:
    """Bits that name a shard, for each choice of fields: the fewest choices that leave `mean` of n random points in a shard."""
    bits = max(0, math.ceil(math.log2(max(1, n) / mean)))
    if not bits:
        return [0]
    m = radius + 1
    while (m - radius) * (64 // m) < bits and m < 64:
        m += 1
    each = min(64 // m, -(-bits // (m - radius)))
    fields = [((1 << each) - 1) << round(64 * k / m) for k in range(m)]
    return [sum(c) for c in combinations(fields, m - radius)]


def dealer(radius: int):
    """Rows of too large shards, dealt by the bits in which the points of a shard differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, shard, differ = (batch[c].to_numpy(zero_copy_only=False).view(_U) for c in ("print", "shard", "differ"))
            out_points, out_shard = [], []
            for mask in np.unique(differ).tolist():
                bits = [b for b in range(64) if mask >> b & 1]
                own = np.flatnonzero(differ == _U(mask))
                for k in range(radius + 1):
                    field = sum(1 << b for b in bits[k :: radius + 1])
                    out_points.append(points[own])
                    out_shard.append(C.mix(C.mix(shard[own] + _U(k + 1)) ^ (points[own] & _U(field))))
            columns = [np.concatenate(x) if x else np.empty(0, _U) for x in (out_points, out_shard)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["print", "shard"])

    return run


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of prints that connect what pairs of prints at this distance connect; points: distinct (print)."""
    masks = shard_masks(points.count(), radius)
    named = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks))))
    rows = C.materialise(points.select("print", named.alias("shard")))
    done = []
    while True:
        large = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_or("print").alias("some"), F.bit_and("print").alias("all")).where(F.col("n") > SHARD_ROWS)
        large = C.materialise(large.select(F.col("shard").alias("__sf_shard"), F.col("some").bitwiseXOR(F.col("all")).alias("differ")))
        again = large.limit(1).count() > 0
        split = rows.join(large, F.col("shard") == F.col("__sf_shard"), "left") if again else None
        done.append(split.where("__sf_shard IS NULL").select("print", "shard") if again else rows)
        if not again:
            break
        rows = C.materialise(split.where("__sf_shard IS NOT NULL").select("print", "shard", "differ").mapInArrow(dealer(radius), "print long, shard long"))
    every = reduce(DataFrame.union, done)
    buckets = max(1, -(-sum(d.count() for d in done) // BUCKET_ROWS))
    return every.groupBy(F.pmod(F.xxhash64("shard"), F.lit(buckets))).applyInArrow(searcher(radius), "a long, b long")


def near_components(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """prints (key, print, ...) with component_id: the least key reachable over links of prints at this distance."""
    own = prints.select(F.col("print").alias("print"), F.col(f"`{key}`").alias("key"))
    points = C.materialise(own.groupBy("print").agg(F.min("key").alias("least")))
    # rows of one key with several prints are one node
    several = own.where("key IS NOT NULL").groupBy("key").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p != q").select(F.col("key").alias("several"), F.col("p").alias("b"))
    same = own.join(several, F.col("key") == F.col("several")).select(F.col("print").alias("a"), "b")
    found = components(near_links(points.select("print"), radius).union(same))
    placed = points.join(found, F.col("print") == F.col("node"), "left").select(F.col("print").alias("__sf_print"), "least", F.coalesce("component", "print").alias("__sf_group"))
    ids = placed.groupBy("__sf_group").agg(F.min("least").alias("component_id")).withColumnRenamed("__sf_group", "__sf_of")
    named = placed.join(ids, F.col("__sf_group") == F.col("__sf_of")).select("__sf_print", "component_id")
    return C.without(prints, "component_id").join(named, F.col("print") == F.col("__sf_print")).drop("__sf_print")


def op9_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = C.materialise(with_prints(C.documents(spark, sf_dir), keep=["doc_id"]))
    return near_components(prints).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """df without the documents whose component has a lesser key; rows of one key stay or go together, null keys stay."""
    prints = C.materialise(with_prints(df, text, keep=[key]))
    gone = near_components(prints, key, radius).where(F.col(f"`{key}`") != F.col("component_id")).select(F.col(f"`{key}`").alias("__sf_key"))
    return df.join(C.materialise(gone.distinct()), F.col(f"`{key}`") == F.col("__sf_key"), "left_anti")


QUERIES = {"op9_simhash_vp": op9_simhash_vp}
ORACLE: dict[str, str] = {}
