"""Substring dedup, suffix dedup, packing, SimHash, fingerprints and mixing against brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from setflow.llm import collection_bwt, common, order_minhash, packing, simhash_vp, source_mix, substring_dedup, suffix_dedup
from setflow.llm.components import components
from tests.llm.fixtures import empty, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df, *names):
    return collections.Counter(tuple(r[n] for n in ("doc_id", *names)) for r in df.collect())


def test_substring_dedup_survives_equal_first_hashes(spark, monkeypatch):
    """First hashes of eight bits: nearly all windows look repeated, and the second count puts that right."""
    data = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
    texts = common.Texts(pa.array([r[1] for r in rows()]))
    first = substring_dedup.window_hashes
    narrow = lambda *args: (*first(*args)[:-1], first(*args)[-1] & np.uint64(255))
    blocks = pa.table({"text": pa.array([r[1] for r in rows()]), substring_dedup.BLOCK: pa.array([0] * len(data), pa.int32())})
    monkeypatch.setattr(substring_dedup, "window_hashes", narrow)
    hashes = np.concatenate([narrow(texts, a, b, 5)[-1] for a, b in texts.groups()])
    pack = lambda rows: substring_dedup.replies(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), substring_dedup.PACKED.types)], schema=substring_dedup.PACKED))
    one = pack(list(substring_dedup.packed_rows(0, hashes, 0)))
    two = substring_dedup.replies(substring_dedup.verifier("text", 5, 0)(blocks, one))
    both = pa.concat_tables([one.append_column("pass", pa.array([1] * one.num_rows)), two.append_column("pass", pa.array([2] * two.num_rows))])
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    got = substring_dedup.remover("text", 5, 0, schema)(blocks, both).to_pylist()
    seen = collections.Counter(tuple(w[k : k + 5]) for _, w in data for k in range(len(w) - 4))
    for (_, w), row in zip(data, got):
        gone = [False] * len(w)
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                gone[k : k + 5] = [True] * 5
        assert (row["n_words"], row["n_removed"], row["kept_text"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))


def test_blocks_and_buckets_grow_in_proportion():
    """Rows of packed hashes: never more than hashes, however many buckets there are."""
    rng = np.random.default_rng(3)
    for bits in (0, 8, 20, 30):
        hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
        found = list(substring_dedup.packed_rows(3, substring_dedup.rotate(np.concatenate([hashes, hashes[:50]]), bits), bits))
        assert len(found) <= 500 and sum(len(common.unpack(r[3])) for r in found) == 500
        table = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), substring_dedup.PACKED.types)], schema=substring_dedup.PACKED)
        assert (substring_dedup.union_of(table, bits) == np.sort(substring_dedup.rotate(hashes, bits))).all()


@pytest.mark.parametrize("window,block_bytes", [(35, 8 << 20), (3, 4000), (35, 500)])
def test_substring_dedup(spark, window, block_bytes):
    df = substring_dedup.remove_repeats(frame(spark), window=window, block_bytes=block_bytes, bucket_hashes=256)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text"]
    data = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in data for k in range(len(w) - window + 1))
    want = collections.Counter()
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert by_row(df, "n_words", "n_removed", "kept_text") == want
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def suffix_rows_of(data, window):
    """Brute force: (doc_id, n_bytes, n_removed, n_spans, kept bytes)."""
    seen = collections.Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return want


def suffix_rows(df):
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in df.collect())


@pytest.mark.parametrize("block_bytes,hot,tape_bytes", [(8 << 20, 8192, 1 << 20), (4000, 8192, 0), (20_000, 1, 1 << 20)])
def test_suffix_dedup(spark, block_bytes, hot, tape_bytes):
    df = suffix_dedup.remove_repeats(frame(spark), block_bytes=block_bytes, bucket_hashes=64, shard_bytes=20_000, hot=hot, tape_bytes=tape_bytes)
    assert suffix_rows(df) == suffix_rows_of([(r[0], (r[1] or "").encode()) for r in rows()], 400)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [5, 1])
def test_suffix_dedup_of_hot_anchors(spark, hot):
    """Passages of 100 to 500 bytes in many surroundings, some of which agree for a while on one side: anchors are cut up to nine times."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passages, sides = [noise(n) for n in (100, 330, 399, 401, 500)], [noise(300) for _ in range(4)]
    data = []
    for k in range(160):
        p, left, right = rng.choice(passages), rng.choice(sides), rng.choice(sides)
        data.append((k, noise(60) + left[rng.randint(0, 300) :] + p + right[: rng.randint(0, 300)] + noise(40)))
    data += [(200, passages[3] * 3), (201, ("ab" * 300)), (202, "z" * 900), (203, data[0][1]), (204, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = suffix_rows(suffix_dedup.remove_repeats(df, block_bytes=9000, bucket_hashes=256, shard_bytes=30_000, hot=hot))
    assert got == suffix_rows_of([(k, (t or "").encode()) for k, t in data], 400)


def test_suffix_dedup_of_texts_longer_than_a_slice(spark):
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    shared = noise(common.SLICE + 5000)
    texts = [noise(300_000) + shared + noise(1000), shared[1000:], noise(common.SLICE - 200) + shared[:400] + noise(700), noise(600_000)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in suffix_dedup.remove_repeats(df, shard_bytes=1 << 18, tape_bytes=0).collect()}
    n = len(shared)
    assert got[0] == (n - 600, 2, texts[0][:300_000] + shared[400:1000] + texts[0][300_000 + n :])
    assert got[1] == (n - 1000, 1, b"") and got[2] == (400, 1, texts[2][: common.SLICE - 200] + texts[2][common.SLICE + 200 :]) and got[3] == (0, 0, texts[3])


@pytest.mark.parametrize("most,piece", [(1 << 20, 1 << 20), (0, 3), (0, 1)])
def test_collection_bwt(tmp_path, most, piece):
    """In memory and through files, in one piece and in pieces of a few numbers."""
    rng = random.Random(3)
    for _ in range(150 if most else 40):
        m = rng.randint(0, 8)
        strings = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 9))], np.int64) for _ in range(m)]
        group = np.array([rng.randint(0, 2) for _ in range(m)], np.int64)
        tapes = collection_bwt.Tapes(None if most else str(tmp_path), most, piece)
        pieces = collection_bwt.collection_bwt(strings, group, tapes)
        parts = next(pieces, None)
        if not most and m:
            assert tapes.files >= 4 and all(f.stat().st_size for f in tmp_path.glob("tapes-*/*"))
        parts = [x for x in [parts, *pieces] if x is not None]
        bwt, string, length, lcp = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0, int)] * 4
        assert not list(tmp_path.iterdir())
        suffix = lambda i, k: (group[i], tuple(strings[i][len(strings[i]) - k :]))
        got = [suffix(i, k) for i, k in zip(string, length)]
        assert got == sorted(suffix(i, k) for i in range(m) for k in range(len(strings[i]) + 1))
        for j in range(1, len(got)):
            n = 0
            if got[j][0] == got[j - 1][0]:
                for x, y in zip(got[j][1], got[j - 1][1]):
                    if x != y:
                        break
                    n += 1
            assert lcp[j] == n
        assert all(b == (strings[i][len(strings[i]) - k - 1] if k < len(strings[i]) else -1) for b, i, k in zip(bwt, string, length))


def test_least_between():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1000, 5000).astype(np.int32)
    low = rng.integers(0, 4999, 3000)
    high = np.minimum(5000, low + 1 + rng.integers(0, 5000, 3000) // rng.integers(1, 500, 3000))
    low[:20], high[:20] = 16 * np.arange(20), 16 * np.arange(20) + 512
    assert (collection_bwt.least_between(x, low[:20], high[:20]) == [x[a:b].min() for a, b in zip(low[:20], high[:20])]).all()
    assert collection_bwt.least_between(x, low, high).tolist() == [x[a:b].min() for a, b in zip(low, high)]


END = "<|endoftext|>"


def untouched():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def packed_rows_of(data, window):
    """What pack_documents says of pieces, from the tokenizer alone."""
    whole, want = untouched(), collections.Counter()
    for key, text in data:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), window):
            part = ids[s : s + window]
            want[key, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    return want


@pytest.mark.parametrize("keys", ["long", "string"])
def test_packing(spark, keys):
    data = [(r[0] if keys == "long" or r[0] is None else f"k{r[0]}", r[1]) for r in rows()]
    more = [f"a {END} b", END, f"{END}{END} x\n{END}", f"word {END}\u00a0odd {END} space", "<|endoftext", f" {END}tail  \n", ("some words " * 30 + END) * 12]
    data += [(1000 + k if keys == "long" else f"m{k}", t) for k, t in enumerate(more)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], f"doc_id {keys}, text string, start string, sequence_id int")
    packed = packing.pack_documents(df, window=256, shard_pieces=40)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and dict(packed.dtypes)["doc_id"].startswith({"long": "bigint", "string": "string"}[keys])
    found = packed.collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == packed_rows_of(data, 256)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(end for _, end in map(max, sequences.values())) <= 256 * len(sequences)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_of_a_hot_group_and_a_long_text(spark):
    """A third of the rows are one row, and one text is longer than a slice: shards stay even, nothing is lost."""
    data = [(7, "the same text")] * 300 + [(100 + k, "word " * (k % 50)) for k in range(600)] + [(9, "a long text of more than a slice\n" * 12_000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = packing.pack_documents(df, shard_pieces=100).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == packed_rows_of(data, 2048)
    filled = collections.Counter()
    for r in found:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len({r["sequence_id"] for r in found if r["doc_id"] == 7}) > 4


@pytest.mark.parametrize("ranked", [True, False])
def test_token_units_equal_whole_texts(ranked):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if ranked else None
    tool = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), ranks, 300)
    whole = untouched()
    rng = random.Random(1)
    plain, odd = " \n\t ab'sS12é#ñ..\r  ", "\xa0漢字😀\u2003\u3000\u0301\x1c\x85\u2028"
    texts = ["".join(rng.choice(plain if rng.random() < 0.8 else odd) if rng.random() < 0.98 else END for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert [list(x) for x in tool.texts(common.Texts(pa.array(texts)))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    latin = [chr(c) for c in range(1, 0x250) if not chr(c).isspace()]
    for _ in range(20_000 if ranked else 100):
        t = "".join(rng.choice(latin if rng.random() < 0.5 else latin[64:122]) for _ in range(rng.randint(1, 14)))
        assert tool.unit(t.encode()) == whole.encode(t).ids and tool.unit(b" " + t.encode()) == whole.encode(" " + t).ids


def test_ranks_must_be_the_merges(tmp_path):
    import public_tokenizers

    other = tmp_path / "other.tiktoken"
    other.write_bytes(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().replace(b"IHRoZQ== 262", b"IHRoZQ== 263", 1))
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), str(other))


def test_tokens_of_the_documents():
    """Every document of sf0.01, whole, against the tokenizer alone."""
    import public_tokenizers
    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    column, whole = pq.read_table(path, columns=["text"])["text"], untouched()
    tool = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for ids, text in zip(tool.texts(common.Texts(column)), column.to_pylist()):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        lengths = rng.integers(1, 65, n)
        sequence, offset = packing.best_fit_decreasing(lengths, 64)
        free: list[int] = []
        where = {}
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(c, i) for i, c in enumerate(free) if c >= lengths[k]]
            best = min(c for c, _ in fits) if fits else None
            where[k] = best
            if best is None:
                free.append(64 - lengths[k])
            else:
                free[max(i for c, i in fits if c == best)] -= lengths[k]
        assert sorted(free) == sorted(64 - np.bincount(sequence, lengths, len(free)).astype(int)) if n else True


def naive_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    prints = simhash_vp.with_prints(frame(spark))
    got = [(r["doc_id"], r["text"], r["print"] & common.MASK) for r in prints.collect()]
    assert all(p == naive_print(t) for _, t, p in got)
    by = {i: p for i, _, p in got if i is not None}
    want = naive_components(list(by), lambda a, b: bin(by[a] ^ by[b]).count("1") <= 4)
    found = simhash_vp.near_components(prints)
    assert all(r["component_id"] == want[r["doc_id"]] for r in found.collect() if r["doc_id"] is not None)
    kept = simhash_vp.first_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in by if want[i] == i} | {None}
    assert simhash_vp.first_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_rows,shard_mean", [(20_000, 128), (50, 32), (20, 1 << 20)])
def test_near_prints(spark, monkeypatch, shard_rows, shard_mean):
    """Chains, groups and random fingerprints, in one shard, in many, and in shards that are dealt again."""
    monkeypatch.setattr(simhash_vp, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash_vp, "shard_masks", lambda n, radius, own=simhash_vp.shard_masks: own(n, radius, shard_mean))
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        v = rng.choice(values)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values += [values[0] ^ (k << 8) for k in range(300)]
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, print long")
    want = naive_components(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= 4)
    assert {r["doc_id"]: r["component_id"] for r in simhash_vp.near_components(df).collect()} == want


def least_linked(points, radius):
    """Brute force: for each point the least of its component, block by block."""
    label = np.arange(len(points))
    links = []
    for a in range(0, len(points), 512):
        i, j = np.nonzero(np.bitwise_count(points[a : a + 512, None] ^ points[None]) <= radius)
        links.append(np.stack([i + a, j]))
    i, j = np.concatenate(links, axis=1)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("batch", [1 << 20, 300])
def test_vantage_point_search(monkeypatch, batch):
    monkeypatch.setattr(simhash_vp, "BATCH", batch)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) for _ in range(3)], np.arange(600, dtype=np.uint64)]))
    label, work = simhash_vp.vantage_point_search(points, np.zeros(len(points), np.int64), 4)
    assert (label == least_linked(points, 4)).all()
    assert work.levels > 3 and work.leaf < work.pairs / 2
    shard = np.sort(rng.integers(0, 5, len(points)))
    label, _ = simhash_vp.vantage_point_search(points, shard, 4)
    for k in range(5):
        own = np.flatnonzero(shard == k)
        assert (label[own] - own[0] == least_linked(points[own], 4)).all()
    assert len(simhash_vp.vantage_point_search(points[:0], shard[:0], 4)[0]) == 0
    n_masks = [len(simhash_vp.shard_masks(n)) for n in (10, 1000, 10**6, 10**8, 10**12)]
    assert n_masks == sorted(n_masks) and n_masks[0] == 1 and n_masks[1] == 5 and n_masks[-1] > 15


def test_trees_do_the_work(spark):
    """At sf0.1: every comparison happens in a tree, trees are cut, and bounds leave out most pairs of a shard."""
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables")
    prints = simhash_vp.with_prints(common.documents(spark, str(folder)), keep=["doc_id"]).toPandas()["print"].to_numpy()
    points = np.unique(prints.view(np.uint64))
    shards = [points & np.uint64(m) for m in simhash_vp.shard_masks(len(points))]
    sizes = [np.unique(x, return_counts=True)[1] for x in shards]
    assert min(x.mean() for x in sizes) > 4 * simhash_vp.LEAF and len(shards) == 5
    total = simhash_vp.Work()
    for own in shards:
        order = np.lexsort((points, own))
        _, at = np.unique(own[order], return_inverse=True)
        _, work = simhash_vp.vantage_point_search(points[order], at, 4)
        total.vantage, total.leaf, total.pairs, total.levels = total.vantage + work.vantage, total.leaf + work.leaf, total.pairs + work.pairs, max(total.levels, work.levels)
    print(total)
    assert total.levels >= 3 and total.vantage + total.leaf < 0.8 * total.pairs
    by = simhash_vp.near_components(spark.createDataFrame([(i, int(v)) for i, v in enumerate(points.view(np.int64))], "doc_id long, print long"))
    got = dict(by.select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(points))] == least_linked(points, 4).tolist()


def test_simhash_keeps_other_columns(spark):
    """Columns with the names that the operator uses inside, and keys that are strings."""
    data = [(f"k{i}", f"some words of text number {i % 3} and more", 1, "n", 2.0, 3, "x", "y", "z") for i in range(6)]
    df = spark.createDataFrame(data, "doc_id string, text string, print int, node string, k double, a int, b string, component string, component_id string")
    prints = simhash_vp.with_prints(df)
    assert sorted(prints.columns) == sorted(df.columns)
    found = simhash_vp.near_components(prints)
    assert sorted(found.columns) == sorted(df.columns)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {f"k{i}": f"k{i % 3}" for i in range(6)}
    kept = simhash_vp.first_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {"k0", "k1", "k2"}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    want = naive_components(sorted({n for a, b in links for n in (a, b) if a != b}), lambda a, b: (a, b) in links or (b, a) in links)
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_source_mix(spark):
    df = frame(spark)
    sized = df.select("doc_id", "source", source_mix.n_words().alias("size"))
    targets = {r["source"]: (r["source_size"], r["target"]) for r in source_mix.source_targets(sized).collect()}
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1, 5)))
    capped: set = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if 2 * sizes[s] < level * weight[s]}
        if more == capped:
            break
        capped = more
    assert targets == {s: (sizes[s], pytest.approx(2 * sizes[s] if s in capped else level * weight[s])) for s in sizes}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    counted = source_mix.with_copies(df, source_mix.source_targets(sized)).collect()
    again = source_mix.with_copies(df, source_mix.source_targets(sized)).collect()
    assert sorted(map(repr, counted)) == sorted(map(repr, again)) and len(counted) == len(rows())
    assert all(0 <= r["copies"] <= 2 for r in counted)
    mixed = source_mix.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in counted)
    assert source_mix.mix(empty(spark)).count() == 0


def naive_order(text):
    """(bin, pair of (k-mer, occurrence) in the order of the text) of each filled bin, with the module's own mixing of single values."""
    mixed = lambda *v: int(common.mix(np.array([sum(a * int(b) for a, b in zip(v, order_minhash._ODD[1:])) + int(order_minhash._ODD[3]) * (len(v) == 2) & common.MASK], np.uint64))[0])
    n, by, seen = len(text), collections.defaultdict(list), collections.Counter()
    for i in range(n):
        kmer = text[i : i + order_minhash.CHARS]
        h = sum((ord(c) + 1) * int(o) for c, o in zip(kmer, order_minhash._ODD)) & common.MASK
        group = int(common.mix(np.array([h], np.uint64))[0]) >> 26
        rank = mixed(group, seen[kmer])
        by[rank >> 58].append((rank >> 26, i, kmer, seen[kmer]))
        seen[kmer] += 1
    return {b: tuple(x[2:] for x in sorted(sorted(v)[:2], key=lambda x: x[1])) for b, v in by.items()}


@pytest.mark.parametrize("range_bytes", [8 << 20, 3000])
def test_order_minhash_of_characters(spark, range_bytes):
    got = order_minhash.character_fingerprints(frame(spark).drop("n_chars"), range_bytes=range_bytes).collect()
    data = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows()), key=lambda r: (r[0], r[1].encode()))
    named = {t: naive_order(t) for _, t in data if len(t) < 4000}
    like = lambda a, b: sum(a.get(k) == v for k, v in b.items()) / len(a.keys() | b.keys()) if a or b else 1.0
    want = collections.Counter()
    for k, (i, text) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        if max(len(text), len(after)) < 4000:
            want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(named[text], naive_order(edited)), like(named[text], named[after])] += 1
    names = ("n_chars", "edited_sha256", "near_edited", "near_next")
    found = collections.Counter((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), *(r[n] for n in names)) for r in got)
    assert len(got) == len(data) and not want - found
    assert order_minhash.character_fingerprints(empty(spark)).count() == 0


def test_order_minhash_of_hot_keys(spark):
    """A third of the rows are one row, a third have one key; every row has the right next text, over ranges too."""
    data = [(5, "the same words again and again " * 3)] * 200 + [(7, f"text number {k} of one key") for k in range(200)] + [(10 + k, f"a text of its own {k * k}") for k in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = order_minhash.character_fingerprints(df, range_bytes=1000).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in data)
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    same = [r for r in got if r["doc_id"] == 5]
    assert sum(r["near_next"] == 1.0 and r["edited_sha256"] == sha(data[0][1], data[0][1]) for r in same) == 199
    by = {r["doc_id"]: r for r in got if r["doc_id"] >= 10}
    assert all(by[10 + k]["edited_sha256"] == sha(data[400 + k][1], data[401 + k][1]) for k in range(199))
    assert by[209]["edited_sha256"] == sha(data[599][1], data[0][1])  # after the last comes the first
    one = order_minhash.character_fingerprints(spark.createDataFrame([(3, "alone here", 1.5, "x")], "doc_id long, text string, near_next double, fingerprint string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == sha("alone here", "alone here")


def test_order_minhash_without_white_space(spark, tmp_path):
    """One changed character of a text without white space leaves most of its fingerprint; so do typos in every second word."""
    chinese = "".join(chr(0x4E00 + (i * i * 7919 + i * 31) % 5000) for i in range(400))
    words = [f"word{i * 37 % 101}example" for i in range(200)]
    typos = " ".join(w[:6] + "#" + w[7:] if i % 2 else w for i, w in enumerate(words))
    data = [(0, chinese), (1, chinese[:200] + "x" + chinese[201:]), (2, " ".join(words)), (3, typos)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in order_minhash.op10_order_minhash(spark, str(tmp_path)).collect()}
    assert 0.8 < got[0]["near_next"] < 1 and got[0]["near_edited"] > 0 and got[2]["near_next"] > 0.2 and got[1]["near_next"] < 0.1


def test_packed_sets():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    assert (common.unpack(common.pack(values)) == values).all()
    assert len(common.unpack(common.pack(values[:0]))) == 0


def test_words_of_odd_batches():
    column = pa.array([None, "a  b", "", " c\td ", None, "é x"]).slice(1)
    texts = common.Texts(column)
    data, offsets = texts.bytes_of(0, texts.n)
    starts, ends, counts = common.word_spans(data, offsets)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends)] == ["a", "b", "c", "d", "é", "x"]
    assert counts.tolist() == [0, 2, 2, 4, 4, 6]
