"""From a graph of computations to DataFrames. Every node is compiled once; Catalyst does the rest."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.functions.terms import Equal, Member, Row, Self, Term, wrap
from setflow.operators import computations as N
from setflow.types import REGISTRY, TypeRegistry

Reader = Callable[[str, str], DataFrame]
#: (database, set, field) -> a copy of the set that is bucketed by the field, or None.
Copies = Callable[[str, str, str], "DataFrame | None"]
#: In a join of many with many: the rows of a key in one piece, on average; the pairs of a task, on average, and of a join that isn't
#: dealt in pieces; the most tasks; the most keys that every task gets.
PIECE_ROWS, TASK_PAIRS, MOST_TASKS, BROADCAST_KEYS = 1 << 11, 1 << 24, 1 << 16, 1 << 18


def as_column(value, rows: list[Row]) -> Column:
    return wrap(value).compile(rows)


def as_columns(fields, rows: list[Row]) -> list[Column]:
    """Columns of a dictionary of fields; a whole input stands for all its fields."""
    if isinstance(fields, Self):
        row = rows[fields.slot]
        return [row[c].alias(c) for c in row.columns]
    return [as_column(v, rows).alias(k) for k, v in fields.items()]


class Compiler:
    """Compiles graphs against a reader of sets."""

    def __init__(self, read: Reader, types: TypeRegistry = REGISTRY, copies: Copies | None = None):
        self.read, self.types, self.copies = read, types, copies
        self._done: dict[int, tuple[N.Computation, DataFrame]] = {}

    def compile(self, node: N.Computation) -> DataFrame:
        if id(node) not in self._done:
            kids = [self.compile(k) for k in node.wired()]
            df = getattr(self, f"_{node.name}")(node, *kids)
            if node.nodes_to_collect is not None:
                df = df.repartition(node.nodes_to_collect)  # not coalesce, which would run the last stage in as few tasks
            self._done[id(node)] = (node, self.types.check(node.out_type, df))
        return self._done[id(node)][1]

    def _row(self, node: N.Computation, slot: int, df: DataFrame, alias: str | None = None) -> Row:
        return Row(df.columns, alias=alias, type_name=node.inputs[slot].out_type or node.in_types[slot], types=self.types)

    def _scan(self, node: N.Scan) -> DataFrame:
        return self.read(node.db, node.set_name)

    def _write(self, node: N.Write, df: DataFrame) -> DataFrame:
        return df

    def _filtered(self, node, df: DataFrame) -> DataFrame:
        return df if node.where is None else df.where(node.where(*node.handles()).compile([self._row(node, 0, df)]))

    def _select(self, node: N.Select, df: DataFrame) -> DataFrame:
        out = self._filtered(node, df)
        return out if node.fields is None else out.select(*as_columns(node.fields(*node.handles()), [self._row(node, 0, df)]))

    def _multi_select(self, node: N.MultiSelect, df: DataFrame) -> DataFrame:
        rows = [self._row(node, 0, df)]
        kept = as_columns(node.keep(*node.handles()), rows) if node.keep else []
        many = self._filtered(node, df).select(*kept, F.explode(node.many(*node.handles()).compile(rows)).alias("__element"))
        if many.schema["__element"].dataType.typeName() == "struct":
            return many.select(*[f"`{c}`" for c in many.columns[:-1]], "__element.*")
        return many.withColumnRenamed("__element", node.element)

    def _join(self, node: N.Join, *frames: DataFrame) -> DataFrame:
        left = list(node.where(*node.handles()).conjuncts()) if node.where else []
        frames = tuple(self._bucketed(node, k, df, left) for k, df in enumerate(frames))
        rows = [self._row(node, k, df, alias=f"in{k}") for k, df in enumerate(frames)]
        if node.many and (pieces := self._in_pieces(node, *frames, left)) is not None:
            one, other, shared = pieces
            condition = None
            for name in shared:
                same = F.col(f"in0.{name}") == F.col(f"in1.{name}")
                condition = same if condition is None else condition & same
            for t in left:
                if not (isinstance(t, Equal) and t.is_key()):
                    condition = condition & t.compile(rows)
            out = one.alias("in0").join(other.alias("in1").hint("merge"), condition, "inner")
            return out.select(*as_columns(node.fields(*node.handles()), rows))
        out, seen, waiting = frames[0].alias("in0"), frozenset([0]), list(range(1, len(frames)))
        while waiting:
            # next comes an input with a key to those joined; inputs without any key are multiplied last
            k = next((k for k in waiting if any(isinstance(t, Equal) and t.is_key() and k in t.inputs() and t.inputs() <= seen | {k} for t in left)), waiting[0])
            waiting.remove(k)
            side = frames[k].alias(f"in{k}")
            if k in node.hints:
                side = side.hint(node.hints[k])
            seen = seen | {k}
            ready = [t for t in left if t.inputs() <= seen]
            left = [t for t in left if not t.inputs() <= seen]
            if not any(isinstance(t, Equal) and t.is_key() for t in ready):
                out = out.crossJoin(side)
                for t in ready:
                    out = out.where(t.compile(rows))
                continue
            condition = None
            for t in ready:
                one = t.compile(rows)
                condition = one if condition is None else condition & one
            out = out.join(side, condition, "inner")
        return out.select(*as_columns(node.fields(*node.handles()), rows))

    def _in_pieces(self, node: N.Join, one: DataFrame, other: DataFrame, terms: list[Term]) -> tuple[DataFrame, DataFrame, list[str]] | None:
        """Both inputs cut into pieces by key, each piece of one beside each of the other, and the columns that name a pair of pieces; None where there are few pairs.

        Rows go to pieces by a hash of all columns, so rows that are equal in all of them share a piece.
        """
        sides = [t.kids if t.kids[0].inputs() == {0} else t.kids[::-1] for t in terms if isinstance(t, Equal) and t.is_key()]
        keys = [f"__key{i}" for i in range(len(sides))]
        dealt = []
        for slot, df in enumerate((one, other)):
            row = self._row(node, slot, df)
            dealt.append(df.withColumns({k: s[slot].compile([row] * 2) for k, s in zip(keys, sides)}))
        for k in keys:  # equal keys must have equal hashes
            kinds = [df.schema[k].dataType for df in dealt]
            if kinds[0].simpleString() != kinds[1].simpleString():
                if not all(isinstance(t, T.NumericType) for t in kinds):
                    return None
                wider = dealt[0].select(k).union(dealt[1].select(k)).schema[k].dataType
                dealt = [df.withColumn(k, F.col(k).cast(wider)) for df in dealt]
        if not keys:
            return None
        n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n{slot}")) for slot, df in enumerate(dealt)]
        both = n[0].join(n[1], keys)
        pairs, found = both.agg(F.sum(F.col("__n0").cast("double") * F.col("__n1")), F.count(F.lit(1))).first()
        if (pairs or 0) <= TASK_PAIRS:
            return None
        both = both.select(*keys, *(F.ceil(F.col(f"__n{slot}") / PIECE_ROWS).cast("int").alias(f"__most{slot}") for slot in (0, 1)))
        both = F.broadcast(both) if found <= BROADCAST_KEYS else both
        shared = [*keys, "__piece0", "__piece1"]
        tasks = min(MOST_TASKS, max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS)))
        for slot, df in enumerate(dealt):
            # a map has no hash
            named = [F.col(f"`{f.name}`") for f in (one, other)[slot].schema.fields if "map<" not in f.dataType.simpleString()]
            own = F.pmod(F.xxhash64(*named), F.col(f"__most{slot}")).cast("int")
            put = df.join(both, keys).withColumn(f"__piece{slot}", own).withColumn(f"__piece{1 - slot}", F.explode(F.sequence(F.lit(0), F.col(f"__most{1 - slot}") - 1)))
            dealt[slot] = put.repartition(tasks, *shared)
        return dealt[0], dealt[1], shared

    def _bucketed(self, node: N.Join, slot: int, df: DataFrame, terms: list[Term]) -> DataFrame:
        """A copy of a scanned set that is bucketed by a field that is a join key, where there is one."""
        source = node.inputs[slot]
        if self.copies is None or not isinstance(source, N.Scan):
            return df
        for key in (t for t in terms if isinstance(t, Equal) and t.is_key()):
            for side in key.kids:
                if isinstance(side, Member) and side.slot == slot and (copy := self.copies(source.db, source.set_name, side.path)) is not None:
                    return copy.select(*[F.col(f"`{c}`") for c in df.columns])
        return df

    def _aggregate(self, node: N.Aggregate, df: DataFrame) -> DataFrame:
        rows = [self._row(node, 0, df)]
        folds = [f.compile(rows).alias(k) for k, f in node.folds(*node.handles()).items()]
        if node.keys is not None and not node.use_combiner:  # rows are dealt by key before anything is folded
            df = df.repartition(*(as_column(v, rows) for v in node.keys(*node.handles()).values()))
        if node.keys is None:  # a constant key: an empty input has no group
            return df.groupBy(F.lit(0).alias("__key")).agg(*folds).drop("__key")
        return df.groupBy(*as_columns(node.keys(*node.handles()), rows)).agg(*folds)

    def _top_k(self, node: N.TopK, df: DataFrame) -> DataFrame:
        rows = [self._row(node, 0, df)]
        score = as_column(node.score(*node.handles()), rows)
        fields = as_columns(node.fields(*node.handles()), rows) if node.fields else [F.col(f"`{c}`") for c in df.columns]
        ties = [t.compile(rows) for t in node.ties(*node.handles())] if node.ties else []
        tied = [t.alias(f"__tie{i}") for i, t in enumerate(ties)]
        ordered = df.select(score.alias(node.score_name), *fields, *tied).orderBy(F.col(node.score_name).desc(), *[F.col(f"__tie{i}") for i in range(len(ties))])
        return ordered.limit(node.k).drop(*[f"__tie{i}" for i in range(len(ties))])

    def _partition(self, node: N.Partition, df: DataFrame) -> DataFrame:
        keys = [as_column(v, [self._row(node, 0, df)]) for v in node.key(*node.handles()).values()]
        return df.repartition(node.partitions, *keys) if node.partitions else df.repartition(*keys)

    def _partition_transform(self, node: N.PartitionTransform, df: DataFrame) -> DataFrame:
        keys = as_columns(node.key(*node.handles()), [self._row(node, 0, df)])
        names = list(node.key(*node.handles()))
        out = df.select(*keys)
        return out.repartition(node.partitions, *names) if node.partitions else out.repartition(*names)


def key_terms(term: Term) -> list[Equal]:
    """The conjuncts that are join keys."""
    return [t for t in term.conjuncts() if isinstance(t, Equal) and t.is_key()]
