"""Language identification with interpolated Kneser-Ney character models.

Method. Texts become sequences of lower-case letters with runs of other characters as one boundary symbol. For each
language the character n-grams of all its training documents are counted in Spark (partial counts in each task). The
highest order keeps raw counts, lower orders count the distinct left neighbours of an n-gram; one absolute discount for
each language and order comes from its counts of counts. The tables are sorted arrays of n-grams with probabilities and
back-off weights. A text goes to the language of the lowest cross-entropy per symbol. No n-gram is folded or dropped:
the tables grow with the corpus. They stay in the shared folder and are broadcast as shards of about TABLE entries: some
languages, or a part of one language by the two symbols before the last. Each shard is a pass over the texts; a text's
sums of all passes are added.

Rejection. Documents of one fold are held back from the counts. Their cross-entropies under their own language's
model give a mean and deviation for each language and power of two of length; a text is rejected if it is more than
REJECT deviations above the mean of its predicted language, or has no letter.

score is the posterior probability of the predicted language, with at most EVIDENCE symbols of evidence.

Defined cases: null texts and texts without a letter are `und`, score 0, rejected; rows with a null language are scored but
teach nothing; without any training row every text is `und`; ties go to the language first in code point order; repeated
rows count as often as they occur; an empty table gives an empty result; input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.llm import common as C

ORDER = 4
#: Entries of the tables of one shard: what is broadcast at once, not the size of a model.
TABLE = 1 << 23
LANGUAGES = 1024
REJECT = 8.0
EVIDENCE = 64
FOLDS = 5
CALIBRATION = 1
OUT = ("lang_pred", "score", "cross_entropy", "rejected")

_U = np.uint64
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark within words, else 0."""
    global _letters
    if _letters is None:
        import unicodedata

        _letters = np.fromiter(("ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)), np.uint8, 0x110000)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Code points of letters in lower case and of marks; runs of others are one 1; the text is enclosed in 1s. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_table()[points]
    if not (kind == 2).any():
        return np.empty(0, _U)
    out = np.ones(len(points) + 2, np.uint32)
    out[1:-1] = np.where(kind > 0, points, 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 1) | (out[:-1] != 1)
    return (out[keep] & np.uint32(0xFFFF)).astype(_U)


def grams(symbol: np.ndarray, order: int) -> np.ndarray:
    """For each symbol after the first the n-gram that ends there: 16 bits a symbol, the last symbol lowest; 0 stands before the text."""
    n = len(symbol) - 1
    out = symbol[1:].copy()
    for k in range(1, order):
        part = np.zeros(n, _U)
        part[max(0, k - 1) :] = symbol[: n - max(0, k - 1)]
        out |= part << _U(16 * k)
    return out


def gram_counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in found.items():
                keys, n = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            pending: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if len(s := symbols(text)):
                    pending.setdefault(lang, []).append(grams(s, order))
            for lang, parts in pending.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                found.setdefault(lang, []).append((keys, n))
                if sum(len(k) for k, _ in found[lang]) > 1 << 18:
                    found[lang] = [merge(found[lang])]
            if sum(len(k) for parts in found.values() for k, _ in parts) > 1 << 20:
                yield from flush()
        yield from flush()
        C.release()

    return run


def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def pair(gram: np.ndarray) -> np.ndarray:
    """A hash of the two symbols before the last."""
    return C.mix(((gram >> _U(16)) & _U(0xFFFFFFFF)) + _U(0x632BE59BD9B4E019))


def part_filler(parts: dict[str, int]):
    """(lang, level, gram, n) with the part of its language; -1 in all parts: n-grams of one and two symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch["gram"].to_numpy(zero_copy_only=False).view(_U)
            of = np.array([parts[x] for x in batch["lang"].to_pylist()], _U)
            part = np.where(batch["level"].to_numpy(zero_copy_only=False) < 2, -1, (pair(gram) % of).astype(np.int32)) if len(gram) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["level"], batch["gram"], batch["n"], pa.array(part.astype(np.int32))], names=["lang", "level", "gram", "n", "part"])

    return run


@dataclass
class Shard:
    """Sorted n-grams for each level of the languages from number `first`; level k holds n-grams of k + 1 symbols."""

    order: int
    first: int
    part: int
    parts: int
    gram_keys: list[list[np.ndarray]]
    gram_p: list[list[np.ndarray]]  # discounted probability
    context_keys: list[list[np.ndarray]]
    context_w: list[list[np.ndarray]]  # weight of the lower order
    floor: list[float]

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each n-gram's last symbol, one column for each language; 0 for n-grams of other parts."""
        out = np.zeros((len(gram), len(self.floor)), np.float32)
        own = np.flatnonzero(pair(gram) % _U(self.parts) == self.part) if self.parts > 1 else slice(None)
        gram = gram[own]
        for j, floor in enumerate(self.floor):
            p = np.full(len(gram), floor)
            for level in range(self.order):
                part = gram & _U((1 << (16 * (level + 1))) - 1)
                w = self._get(self.context_keys[j][level], self.context_w[j][level], part >> _U(16), 1.0)
                p = self._get(self.gram_keys[j][level], self.gram_p[j][level], part, 0.0) + w * p
            out[own, j] = np.log(p)
        return out

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), other)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, values[at], other)


@dataclass
class Model:
    """What is known of all languages; the n-grams (lang, level, gram, n, part) stay in `table`, and a shard of them is loaded at a time."""

    order: int
    langs: list[str]
    table: DataFrame
    shards: list[tuple[int, int, int, int]]  # languages from, to; part, parts
    discount: dict[tuple[str, int], float]
    seen: dict[str, int]
    limits: dict | None = None  # language -> (per power of two of length: mean + REJECT deviations)
    loaded: tuple[int, Shard] | None = None

    def shard(self, k: int) -> Shard:
        if self.loaded is None or self.loaded[0] != k:
            self.loaded = None
            a, b, part, _ = self.shards[k]
            self.loaded = (k, self._build(k, self.table.where(F.col("lang").isin(self.langs[a:b]) & F.col("part").isin(-1, part)).select("lang", "level", "gram", "n").toArrow()))
        return self.loaded[1]

    def _build(self, k: int, rows: pa.Table) -> Shard:
        import pyarrow.compute as pc

        a, b, part, parts = self.shards[k]
        number = pc.index_in(rows["lang"], value_set=pa.array(self.langs[a:b], pa.string())).to_numpy()
        level, gram, n = rows["level"].to_numpy(), rows["gram"].to_numpy().view(_U), rows["n"].to_numpy()
        out = Shard(self.order, a, part, parts, [], [], [], [], [])
        for j, x in enumerate(self.langs[a:b]):
            gk, gp, ck, cw = [], [], [], []
            for lev in range(self.order):
                d = self.discount.get((x, lev), 0.5)
                own = np.flatnonzero((number == j) & (level == lev))
                own = own[np.argsort(gram[own])]
                keys, count = gram[own], n[own].astype(float)
                context, start, types = np.unique(keys >> _U(16), return_index=True, return_counts=True)
                total = np.add.reduceat(count, start) if len(start) else np.empty(0)
                gk.append(keys)
                gp.append((count - d) / np.repeat(total, types))
                ck.append(context)
                cw.append(d * types / total)
            out.gram_keys.append(gk), out.gram_p.append(gp), out.context_keys.append(ck), out.context_w.append(cw)
            out.floor.append(1.0 / (self.seen.get(x, 0) + 256))
        return out

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """As of a shard, over all shards."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        for k, (a, b, _, _) in enumerate(self.shards):
            out[:, a:b] += self.shard(k).log_p(gram)
        return out


def plan(entries: list[int], table: int, split: bool) -> list[tuple[int, int, int, int]]:
    """Shards of languages with so many entries each: neighbours of at most `table` entries together, or parts of a larger language."""
    out: list[tuple[int, int, int, int]] = []
    a, size = 0, 0
    for k, n in enumerate(entries):
        if k > a and size + n > table:
            out.append((a, k, 0, 1))
            a, size = k, 0
        size += n
        if split and n > table:
            parts = -(-n // table)
            out += [(k, k + 1, i, parts) for i in range(parts)]
            a, size = k + 1, 0
    return out + ([(a, len(entries), 0, 1)] if a < len(entries) else [])


def train(labelled: DataFrame, order: int = ORDER, table: int = TABLE) -> Model | None:
    """A model from rows (text, lang) without nulls; None without any row."""
    spark = labelled.sparkSession
    C.bounded_batches(spark)
    schema = "lang string, gram long, n long"
    full = labelled.mapInArrow(gram_counter(order), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    full = C.materialise(full.withColumn("level", F.lit(order - 1)))
    levels = full
    part = full
    for k in range(order - 2, -1, -1):  # distinct left neighbours
        mask = (1 << (16 * (k + 1))) - 1
        part = part.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(k))
        levels = levels.unionByName(part)
    levels = C.materialise(levels)
    counts = levels.groupBy("lang", "level").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count(F.lit(1)).alias("types"))
    counted = counts.limit(LANGUAGES * order + 1).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in counted})
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not langs:
        return None
    entries = dict.fromkeys(langs, 0)
    for r in counted:
        entries[r["lang"]] += 2 * r["types"]  # at most one context for each n-gram
    shards = plan([entries[x] for x in langs], table, order > 2)
    parts = {langs[a]: of for a, _, _, of in shards if of > 1}
    if parts:
        own = levels.select("lang", "level", "gram", "n").mapInArrow(part_filler({x: parts.get(x, 1) for x in langs}), "lang string, level int, gram long, n long, part int")
        levels = C.materialise(own)
    else:
        levels = levels.withColumn("part", F.lit(-1))
    discount = {(r["lang"], r["level"]): (r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5) for r in counted}
    return Model(order, langs, levels, shards, discount, {r["lang"]: r["types"] for r in counted if r["level"] == 0})


class Scorer:
    """Cross-entropies of texts; n-grams met before are remembered in a direct-mapped table."""

    SLOTS = 1 << 20

    def __init__(self, model: Shard):
        self.model = model
        self.keys = np.zeros(self.SLOTS, _U)
        self.values = np.zeros((self.SLOTS, len(model.floor)), np.float32)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        slot = (C.mix(gram) >> _U(44)).astype(np.int64)
        lost = np.flatnonzero(self.keys[slot] != gram)
        if len(lost):
            new, at = np.unique(gram[lost], return_inverse=True)
            value = self.model.log_p(new)
            own = (C.mix(new) >> _U(44)).astype(np.int64)
            self.keys[own], self.values[own] = new, value
            # of new n-grams that share a slot the last one stays; all take their own values
            out = self.values[slot]
            out[lost] = value[at]
            return out
        return self.values[slot]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of logarithms for each text and language, number of symbols of each text)."""
        total, length = np.zeros((len(texts), len(self.model.floor))), np.zeros(len(texts), np.int64)
        held, size = [], 0

        def work() -> None:
            if held:
                value = self.log_p(np.concatenate([g for _, g in held]))
                at = np.concatenate([[0], np.cumsum([len(g) for _, g in held])[:-1]])
                np.add.at(total, [k for k, _ in held], np.add.reduceat(value, at, axis=0, dtype=np.float64))
                held.clear()

        for k, text in enumerate(texts):
            if text and len(s := symbols(text)):
                gram = grams(s, self.model.order)
                length[k] = len(gram)
                for a in range(0, len(gram), 1 << 18):
                    held.append((k, gram[a : a + (1 << 18)]))
                    size += len(held[-1][1])
                    if size >= 1 << 18:
                        work()
                        size = 0
        work()
        return total, length


_current: Scorer | None = None


def scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast shard."""
    global _current
    if _current is None or _current.model is not shared.value:
        _current = Scorer(shared.value)
    return _current


def predict(total: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, its cross-entropy, its posterior) of each text with letters."""
    entropy = -total / np.maximum(length, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(best)), best]
    odds = np.exp(-(entropy - least[:, None]) * np.minimum(length, EVIDENCE)[:, None])
    return best, least, 1.0 / odds.sum(axis=1)


def octave(length: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(length, 1)).astype(np.int32)


def scorer_of(shared, names: list[str], text: str):
    """The named columns with each text's number of symbols and its sums under the shard's languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tool = scorer(shared)
            total, length = tool.texts(batch[text].to_pylist())
            width = total.shape[1]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), pa.array(total.ravel()))
            first = np.full(len(total), tool.model.first, np.int32)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(length), pa.array(first), sums], names=[*names, "__sf_length", "__sf_first", "__sf_sums"])
        C.release()

    return run


def in_passes(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """rows with __sf_length and __sf_all, the (__sf_first, __sf_sums) of all shards; each shard is one pass over the texts."""
    rows = C.materialise(rows.withColumn("__sf_id", F.monotonically_increasing_id()))
    schema = "__sf_id long, __sf_length long, __sf_first int, __sf_sums array<double>"
    found = None
    for k in range(len(model.shards)):
        shared = rows.sparkSession.sparkContext.broadcast(model.shard(k))
        one = C.materialise(rows.select("__sf_id", text).mapInArrow(scorer_of(shared, ["__sf_id"], text), schema))
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    model.loaded = None
    sums = found.groupBy("__sf_id").agg(F.first("__sf_length").alias("__sf_length"), F.collect_list(F.struct("__sf_first", "__sf_sums")).alias("__sf_all"))
    return rows.join(sums, "__sf_id").drop("__sf_id")


def added(column: pa.Array, width: int) -> np.ndarray:
    """Sums by text and language of __sf_all; parts of one language add up in the order of their values, so always alike."""
    out = np.zeros((len(column), width))
    for k, shards in enumerate(column.to_pylist()):
        for x in sorted(shards, key=lambda x: (x["__sf_first"], x["__sf_sums"])):
            out[k, x["__sf_first"] : x["__sf_first"] + len(x["__sf_sums"])] += x["__sf_sums"]
    return out


def totals(shared, text: str, width: int):
    """(sums, lengths) of a batch: scored by the broadcast shard, or added from passes where there is none."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if shared is None:
            return added(batch["__sf_all"], width), batch["__sf_length"].to_numpy(zero_copy_only=False)
        return scorer(shared).texts(batch[text].to_pylist())

    return of


def with_totals(rows: DataFrame, model: Model, text: str) -> tuple[DataFrame, Callable]:
    """The rows to map over, and what gives the totals of a batch of them."""
    if len(model.shards) > 1:
        return in_passes(rows, model, text), totals(None, text, len(model.langs))
    return rows, totals(rows.sparkSession.sparkContext.broadcast(model.shard(0)), text, len(model.langs))


def classifier(of: Callable, names: list[str], langs: list[str], known: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, length = of(batch)
            best, entropy, score = predict(total, length)
            none = length == 0
            limits = np.array([known[x] for x in langs]) if known else np.full((len(langs), 64), np.inf)
            rejected = none | (entropy > limits[best, octave(length)])
            lang = np.array(langs, object)[best]
            lang[none] = "und"
            out = [pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(entropy, mask=none), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + out, names=[*names, *OUT])
        C.release()

    return run


def measure(of: Callable, names: list[str]):
    """Sums of cross-entropies of labelled texts under their own language, by language and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            total, length = of(batch)
            langs = batch["lang"].to_pylist()
            good = np.flatnonzero((length > 0) & np.array([x in number for x in langs], bool))
            own = np.array([number[langs[k]] for k in good], np.int64)
            x = -total[good, own] / length[good]
            group, at = np.unique(own * 64 + octave(length[good]), return_inverse=True)
            sums = [np.bincount(at, w, len(group)) for w in (np.ones(len(good)), x, x * x)]
            yield pa.RecordBatch.from_arrays([pa.array(group), *(pa.array(s) for s in sums)], names=["cell", "n", "x", "xx"])

    return run


def calibrate(model: Model, held: DataFrame, reject: float = REJECT) -> Model:
    """Limits of cross-entropy for each language and power of two of length; few texts of a length borrow from the language's others."""
    rows, of = with_totals(held, model, "text")
    sums = rows.mapInArrow(measure(of, model.langs), "cell long, n double, x double, xx double").groupBy("cell").agg(F.sum("n"), F.sum("x"), F.sum("xx")).toArrow()
    stats = np.zeros((len(model.langs), 64, 3))
    for c, *s in zip(*(col.to_pylist() for col in sums.columns)):
        stats[c // 64, c % 64] = s
    model.limits = {}
    for j, x in enumerate(model.langs):
        limit = np.full(64, np.inf)
        for k in range(64):
            n, s, ss = stats[j, k]
            wide = 0
            while n < 30 and wide < 64:  # borrow from neighbouring lengths
                wide += 1
                n, s, ss = stats[j, max(0, k - wide) : k + wide + 1].sum(axis=0)
            if n >= 30:
                mean = s / n
                limit[k] = mean + reject * max(np.sqrt(max(0.0, ss / n - mean * mean)), 0.02 * mean)
        limit[:3] = np.inf  # fewer than eight symbols tell nothing
        model.limits[x] = limit
    return model


def crc_fold(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER, folds: int = FOLDS, table: int = TABLE) -> Model | None:
    """A calibrated model from the rows outside fold 0; fold CALIBRATION is kept for the limits."""
    fold = crc_fold(F.col(f"`{key}`"), folds)
    rows = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), fold.alias("fold"))
    model = train(rows.where((F.col("fold") != 0) & (F.col("fold") != CALIBRATION)).select("text", "lang"), order, table)
    if model is None:
        return None
    return calibrate(model, rows.where(F.col("fold") == CALIBRATION).select("text", "lang"))


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df with lang_pred, score, cross_entropy and rejected."""
    C.bounded_batches(df.sparkSession)
    names = [n for n in (keep if keep is not None else df.columns) if n.lower() not in OUT]
    kept = [F.col(f"`{n}`") for n in names]
    read = text if text in names and df.schema[text].dataType == T.StringType() else "__sf_text"
    own = df.select(*kept, *([F.col(f"`{text}`").cast("string").alias(read)] if read != text else []))
    if model is None:
        return own.select(*kept).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    schema = T.StructType([*own.schema.fields[: len(names)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    scored, of = with_totals(own, model, read)
    return scored.mapInArrow(classifier(of, names, model.langs, model.limits), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
