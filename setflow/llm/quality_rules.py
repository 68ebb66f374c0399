"""Quality rules: base counts of a text, and how far its histograms diverge from those of languages.

Method. A language's reference is two histograms over all its documents: character classes, and its common words (share of
MIN_SHARE or more of its words, by 64-bit hash in lower case) with one bin for all others. Common words are found with
Misra-Gries summaries of SUMMARY counters, which keep every word of a share above 1 / (SUMMARY + 1) whatever the data,
merge in two levels, and bound what a second pass counts exactly and what is broadcast: a language has 1 / MIN_SHARE common
words at most, and references are sparse. More than LANGUAGES languages raise a ValueError. A text's Jensen-Shannon distance
(base 2, 0 to 1) is taken to the nearest reference for each histogram. It passes if both distances stay below their
limits; short texts scatter, so a limit rises by NOISE * bins / count, and a histogram of too few counts
(MIN_CHARS, MIN_WORDS) isn't judged.

Base rules: base_failed if n_words < 50 or over half of the words lie in 3-word windows that occur twice or more.

Defined cases: a null or empty text has no words and fails; a text of any length is counted whole, in one task; null languages
form a reference of their own, and so do empty ones; a text that is as near to two references takes the bins of the first in
the order of languages, null last; an empty table gives an empty result; repeated rows count as often as they occur; input
columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C

MIN_SHARE = 0.002
SUMMARY = 1000
LANGUAGES = 1024
MIN_CHARS, MIN_WORDS = 200, 50
CLASS_LIMIT, WORD_LIMIT, NOISE = 0.30, 0.44, 0.02
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")

_SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(256, 12, np.uint8)  # controls and whatever else
    groups = (b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOUBCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"-()/", _SYMBOLS, b"@[]\\^_`{}~=+")
    for k, group in enumerate(groups):
        table[list(group)] = k
    table[0x80:0xC0] = 255  # not the first byte of a character
    table[0xC0:0xC4], table[0xC4:0xE0], table[0xE0:0xF0], table[0xF0:] = 11, 13, 14, 15
    return table


CLASSES = 16
_CLASS = _class_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    first = kind != 255
    return np.bincount(owner[first] * CLASSES + kind[first], minlength=n * CLASSES).reshape(n, CLASSES)


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, and words before each text."""
    starts, ends, counts = C.word_spans(data, offsets)
    return C.word_hashes(_LOWER[data], starts, ends), counts


# --- common words ----------------------------------------------------------------------------------


def shrink(keys: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: at most `most` counters stay, each less the first count that doesn't."""
    if len(keys) <= most:
        return keys, n
    cut = np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    stay = n > cut
    return keys[stay], n[stay] - cut


def join_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


SUMMARIES = "lang string, part int, keys binary, counts binary"


def _summary_batch(found: dict, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([k.tobytes() for k, _ in found.values()], pa.binary()), pa.array([n.tobytes() for _, n in found.values()], pa.binary())],
        names=["lang", "part", "keys", "counts"],
    )


def summariser(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = C.Texts(batch["text"]), np.array(batch["lang"].to_pylist(), object)
            for a, b in texts.groups(1 << 20):
                words, counts = lower_words(*texts.bytes_of(a, b))
                owner = np.repeat(langs[a:b], np.diff(counts))
                for lang in set(langs[a:b].tolist()):
                    own = np.unique(words[owner == lang], return_counts=True)
                    found[lang] = shrink(*join_counts([own, found[lang]] if lang in found else [own]), most)
        context = TaskContext.get()
        yield _summary_batch(found, context.partitionId() if context else 0)

    return run


def merger(most: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)) for k, n in zip(table["keys"].to_pylist(), table["counts"].to_pylist())]
        while len(parts) > 1:
            parts = [shrink(*join_counts(parts[k : k + 32]), most) for k in range(0, len(parts), 32)]
        return pa.Table.from_batches([_summary_batch({table["lang"][0].as_py(): parts[0]}, 0)])

    return run


def common_candidates(rows: DataFrame, most: int = SUMMARY) -> dict[str | None, np.ndarray]:
    """For each language at most `most` word hashes, among them every word of a share above 1 / (most + 1)."""
    parts = rows.mapInArrow(summariser(most), SUMMARIES).withColumn("part", F.pmod("part", F.lit(64)))
    once = parts.groupBy("lang", "part").applyInArrow(merger(most), SUMMARIES)
    merged = once.groupBy("lang").applyInArrow(merger(most), SUMMARIES).limit(LANGUAGES + 1).toArrow()
    if merged.num_rows > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: np.sort(np.frombuffer(r["keys"], np.uint64)) for r in merged.to_pylist()}


# --- references --------------------------------------------------------------------------------------


@dataclass
class References:
    """Histograms of languages; of the words only the common ones of each language are held."""

    langs: list[str | None]
    classes: np.ndarray  # [language, class]: shares
    words: np.ndarray  # all common words of all languages, sorted
    start: np.ndarray  # of each word, and the end: its languages in the next two arrays
    lang: np.ndarray
    share: np.ndarray
    others: np.ndarray  # share of each language's uncommon words
    bins: np.ndarray  # of each language


def exact_counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates: dict[str | None, np.ndarray] = shared.value
        classes: dict[str | None, np.ndarray] = {}
        words: dict[str | None, np.ndarray] = {}
        for batch in batches:
            texts, langs = C.Texts(batch["text"]), np.array(batch["lang"].to_pylist(), object)
            for a, b in texts.groups():
                data, offsets = texts.bytes_of(a, b)
                kinds = class_counts(data, offsets)
                hashes, counts = lower_words(data, offsets)
                owner = np.repeat(langs[a:b], np.diff(counts))
                for lang in set(langs[a:b].tolist()):
                    table = candidates[lang]
                    if lang not in classes:
                        classes[lang], words[lang] = np.zeros(CLASSES, np.int64), np.zeros(len(table) + 1, np.int64)
                    classes[lang] += kinds[langs[a:b] == lang].sum(axis=0)
                    own = hashes[owner == lang]
                    hit = C.member(own, table)
                    words[lang][:-1] += np.bincount(np.searchsorted(table, own[hit]), minlength=len(table))[: len(table)]
                    words[lang][-1] += len(own)
        rows = [(lang, 0, k, int(n)) for lang, x in classes.items() for k, n in enumerate(x)]
        rows += [(lang, 1, k, int(n)) for lang, x in words.items() for k, n in enumerate(x)]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "kind", "k", "n"])

    return run


def references(df: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE, most: int = SUMMARY) -> References | None:
    C.bounded_batches(df.sparkSession)
    rows = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    candidates = common_candidates(rows, most)
    if not candidates:
        return None
    shared = df.sparkSession.sparkContext.broadcast(candidates)  # at most LANGUAGES * SUMMARY hashes
    sums = rows.mapInArrow(exact_counter(shared), "lang string, kind int, k int, n long").groupBy("lang", "kind", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(candidates, key=lambda x: (x is None, x or ""))
    classes = {x: np.zeros(CLASSES) for x in langs}
    counts = {x: np.zeros(len(candidates[x]) + 1) for x in langs}
    for x, kind, k, n in zip(*(c.to_pylist() for c in sums.columns)):
        (counts if kind else classes)[x][k] = n
    held = {x: counts[x][:-1] >= min_share * max(1.0, counts[x][-1]) for x in langs}
    size = np.array([held[x].sum() for x in langs])
    words = np.concatenate([candidates[x][held[x]] for x in langs])
    share = np.concatenate([counts[x][:-1][held[x]] / max(1.0, counts[x][-1]) for x in langs])
    number = np.repeat(np.arange(len(langs)), size)
    order = np.lexsort((number, words))
    every, start = np.unique(words[order], return_index=True)
    table = np.array([classes[x] / max(1.0, classes[x].sum()) for x in langs])
    return References(langs, table, every, np.append(start, len(words)), number[order], share[order], 1.0 - np.bincount(number, share, len(langs)), size + 1)


def entropy_terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, over the last axis."""
    return np.maximum(0.0, entropy_terms(p, q).sum(axis=-1) / 2)


def distances(ref: References, kinds: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance of classes, distance of words, bins of the nearest word reference) of each text to its nearest references."""
    n, n_langs = len(kinds), len(ref.langs)
    step = max(1, (1 << 20) // (CLASSES * n_langs))
    if n > step:  # some texts at a time
        parts = [distances(ref, kinds[a : a + step], hashes[counts[a] : counts[min(n, a + step)]], counts[a : a + step + 1] - counts[a]) for a in range(0, n, step)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    p = kinds / np.maximum(1, kinds.sum(axis=1))[:, None]
    by_class = np.sqrt(divergence(p[:, None, :], ref.classes[None])).min(axis=1)
    at = np.searchsorted(ref.words, hashes)
    at[at == len(ref.words)] = 0
    hit = ref.words[at] == hashes if len(ref.words) else np.zeros(len(hashes), bool)
    owner = np.repeat(np.arange(n), np.diff(counts))
    # each common word of each text, once for every language that has it
    cell, times = np.unique(owner[hit] * max(1, len(ref.words)) + at[hit], return_counts=True)
    text, word = np.divmod(cell, max(1, len(ref.words)))
    have = ref.start[word + 1] - ref.start[word]
    place = np.arange(have.sum()) + np.repeat(ref.start[word] - np.cumsum(have) + have, have)
    own, q = np.repeat(text, have), ref.share[place]
    share = np.repeat(times / np.maximum(1, np.diff(counts))[text], have)
    by = own * n_langs + ref.lang[place]
    # a common word that a text doesn't have adds the language's share of it
    more = np.bincount(by, entropy_terms(share, q) - q, n * n_langs).reshape(n, n_langs)
    others = np.maximum(0.0, (np.diff(counts) > 0)[:, None] - np.bincount(by, share, n * n_langs).reshape(n, n_langs))
    twice = more + (1.0 - ref.others) + entropy_terms(others, np.broadcast_to(ref.others, others.shape))
    nearest = twice.argmin(axis=1)
    return by_class, np.sqrt(np.clip(twice[np.arange(n), nearest] / 2, 0.0, 1.0)), ref.bins[nearest]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, counts = C.word_spans(data, offsets)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80) - 0])
    in_words = (chars[ends] - chars[starts]) if len(starts) else np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(in_words)])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    hashes = C.rolling(C.word_hashes(data, starts, ends), 3, C._BASE["word"][1])
    at = np.flatnonzero(C.window_mask(counts, 3))
    owner = np.searchsorted(counts, at, side="right") - 1
    key = C.mix(hashes[at] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = np.concatenate([[0], np.cumsum(C.covered(at[times[place] > 1], 3, len(starts)))])
    dup = np.zeros(n, np.int64)
    for k in range(n):
        lines = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            worded = [x for x in lines if x and not x.isspace()]
            dup[k] = len(worded) - len(set(worded))
    return {"n_words": np.diff(counts), "word_chars": np.diff(sums[counts]), "n_symbols": np.diff(symbols[offsets]), "n_dup_lines": dup, "n_repeat_words": np.diff(repeated[counts])}


def ruler(shared, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref: References | None = shared.value
        for batch in batches:
            texts = C.Texts(batch[text])
            parts: list[list[np.ndarray]] = []
            for a, b in texts.groups():
                data, offsets = texts.bytes_of(a, b)
                base = base_counts(data, offsets)
                words, repeat = base["n_words"], base["n_repeat_words"]
                failed = (words < 50) | (100 * repeat > 50 * words)
                kinds = class_counts(data, offsets)
                if ref is None:
                    by_class, by_word, good = np.zeros(b - a), np.zeros(b - a), np.ones(b - a, bool)
                else:
                    by_class, by_word, bins = distances(ref, kinds, *lower_words(data, offsets))
                    chars = kinds.sum(axis=1)
                    good = (chars < MIN_CHARS) | (by_class <= CLASS_LIMIT + NOISE * CLASSES / np.maximum(1, chars))
                    good &= (words < MIN_WORDS) | (by_word <= WORD_LIMIT + NOISE * bins / np.maximum(1, words))
                parts.append([*base.values(), failed, ~failed & good, by_class, by_word])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0)] * len(OUT)
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + [pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2)], names=[*names, *OUT])

    return run


def apply_rules(df: DataFrame, ref: References | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df with counts, distances and verdicts."""
    C.bounded_batches(df.sparkSession)
    names = [n for n in (keep if keep is not None else df.columns) if n.lower() not in OUT]
    own = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias("__sf_text"))
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] * 2
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(OUT, kinds))])
    return own.mapInArrow(ruler(df.sparkSession.sparkContext.broadcast(ref), names, "__sf_text"), schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return apply_rules(docs, references(docs), keep=["doc_id"]).select("doc_id", *OUT)


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE: dict[str, str] = {}
