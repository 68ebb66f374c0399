"""Computations: the nodes of a graph from scans to writes.

A node has numbered input slots. Wiring compares the declared element types; a declared type of None fits any. Several
nodes may consume one; it is compiled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from setflow.functions.terms import Handle, Term, wrap

Fields = dict[str, "Term | Column | object"]


class Computation:
    arity = 1
    in_types: tuple[str | None, ...] = (None,)
    out_type: str | None = None
    name = "computation"

    def __init__(self, *inputs: Computation, in_types: tuple[str | None, ...] | None = None, out_type: str | None = None):
        self.inputs: list[Computation | None] = [None] * self.arity
        self.in_types = in_types or (None,) * self.arity
        self.out_type = out_type
        self.consumers: list[Computation] = []
        self.output: tuple[str, str] | None = None
        self.nodes_to_collect: int | None = None
        self.use_combiner = True
        self.batch_rows: int | None = None
        for slot, node in enumerate(inputs):
            self.set_input(slot, node)

    def set_input(self, slot: int, node: Computation) -> Computation:
        """Wire node into a slot; TypeError if its declared type isn't the slot's."""
        if not 0 <= slot < self.arity:
            raise IndexError(f"{self.name} has {self.arity} inputs, no slot {slot}")
        want = self.in_types[slot]
        if want is not None and node.out_type is not None and want != node.out_type:
            raise TypeError(f"slot {slot} of {self.name} takes {want}, not {node.out_type}")
        self.inputs[slot] = node
        node.consumers.append(self)
        return self

    def set_output(self, db: str, name: str) -> Computation:
        """Also write this node's rows to a set."""
        self.output = (db, name)
        return self

    def set_collect_as_map(self, nodes: int = 1) -> Computation:
        """Gather the result in this many partitions."""
        self.nodes_to_collect = nodes
        return self

    def set_using_combiner(self, use: bool) -> Computation:
        """Without it an aggregate deals its rows by key first, so nothing is folded before the shuffle."""
        self.use_combiner = use
        return self

    def set_batch_size(self, rows: int) -> Computation:
        """Kept for the interface: batches are Tungsten's choice."""
        self.batch_rows = rows
        return self

    def handles(self) -> list[Handle]:
        return [Handle(k) for k in range(self.arity)]

    def wired(self) -> list[Computation]:
        missing = [k for k, node in enumerate(self.inputs) if node is None]
        if missing:
            raise ValueError(f"{self.name} has no input in slots {missing}")
        return list(self.inputs)  # type: ignore[arg-type]


class Scan(Computation):
    """All rows of a set."""

    arity = 0
    name = "scan"

    def __init__(self, db: str, set_name: str, out_type: str | None = None):
        super().__init__(out_type=out_type)
        self.db, self.set_name = db, set_name


class Write(Computation):
    """Append the input to a set that exists."""

    name = "write"

    def __init__(self, source: Computation, db: str, set_name: str):
        super().__init__(source, out_type=source.out_type)
        self.db, self.set_name = db, set_name


class Select(Computation):
    """Rows for which `where` holds, each turned into the fields of `fields` (all fields where None)."""

    name = "select"

    def __init__(self, source: Computation, where: Callable[[Handle], Term] | None = None, fields: Callable[[Handle], Fields] | None = None, **types):
        super().__init__(source, **types)
        self.where, self.fields = where, fields


class MultiSelect(Computation):
    """Rows for which `where` holds, each turned into one row for each element of `many`.

    Elements that are structs become their fields; others the field `name`. `keep` are further fields, repeated.
    An empty or null array gives no row.
    """

    name = "multi_select"

    def __init__(self, source: Computation, many: Callable[[Handle], Term], where: Callable[[Handle], Term] | None = None, keep: Callable[[Handle], Fields] | None = None, element: str = "value", **types):
        super().__init__(source, **types)
        self.where, self.many, self.keep, self.element = where, many, keep, element


class Join(Computation):
    """Rows of all inputs for which `where` holds. Equalities between inputs become join keys, all else residual conditions.

    hints: for slots after the first, a Spark join hint by slot, such as broadcast or shuffle_hash.
    many: in a join of two inputs, many rows of both may share a key. When the graph is compiled, rows are counted by key, and
    keys with many pairs are dealt out in pieces (compiler.PIECE_ROWS), so that no task makes all pairs of a key.
    """

    name = "join"

    def __init__(self, *inputs: Computation, where: Callable[..., Term] | None, fields: Callable[..., Fields], hints: dict[int, str] | None = None, many: bool = False, **types):
        self.arity = len(inputs)
        if self.arity < 2:
            raise ValueError("a join has two inputs at least")
        if many and (self.arity > 2 or hints):
            raise ValueError("a join of many with many has two inputs and no hints")
        super().__init__(*inputs, **types)
        self.where, self.fields, self.hints, self.many = where, fields, hints or {}, many


@dataclass
class Fold:
    """One aggregate over a term."""

    kind: str
    term: Term | None
    make: Callable[[Column | None], Column]

    def compile(self, rows) -> Column:
        return self.make(self.term.compile(rows) if self.term is not None else None)


def sum_of(term) -> Fold:
    return Fold("sum", wrap(term), F.sum)


def exact_sum_of(term, scale: int = 4) -> Fold:
    """A sum of decimals, which doesn't depend on the order of rows, as a double."""
    return Fold(f"exact_sum_{scale}", wrap(term), lambda c: F.sum(c.cast(f"decimal(18,{scale})")).cast("double"))


def exact_avg_of(term, scale: int = 4) -> Fold:
    return Fold(f"exact_avg_{scale}", wrap(term), lambda c: F.sum(c.cast(f"decimal(18,{scale})")).cast("double") / F.count(c).cast("double"))


def count_of(term=None) -> Fold:
    return Fold("count", None if term is None else wrap(term), lambda c: F.count(F.lit(1) if c is None else c))


def min_of(term) -> Fold:
    return Fold("min", wrap(term), F.min)


def max_of(term) -> Fold:
    return Fold("max", wrap(term), F.max)


def avg_of(term) -> Fold:
    return Fold("avg", wrap(term), F.avg)


def list_of(term) -> Fold:
    """All values, sorted."""
    return Fold("list", wrap(term), lambda c: F.sort_array(F.collect_list(c)))


def fold(term, make: Callable[[Column], Column], kind: str = "fold") -> Fold:
    """Any Spark aggregate."""
    return Fold(kind, wrap(term), make)


class Aggregate(Computation):
    """Rows with equal keys folded; without keys one row, or none for an empty input."""

    name = "aggregate"

    def __init__(self, source: Computation, keys: Callable[[Handle], Fields] | None, folds: Callable[[Handle], dict[str, Fold]], **types):
        super().__init__(source, **types)
        self.keys, self.folds = keys, folds


class TopK(Computation):
    """The k rows of the largest score; equal scores in the order of `ties`."""

    name = "top_k"

    def __init__(self, source: Computation, k: int, score: Callable[[Handle], Term], fields: Callable[[Handle], Fields] | None = None, ties: Callable[[Handle], list[Term]] | None = None, score_name: str = "score", **types):
        super().__init__(source, **types)
        self.k, self.score, self.fields, self.ties, self.score_name = k, score, fields, ties, score_name


class Partition(Computation):
    """The rows, dealt to partitions by key."""

    name = "partition"

    def __init__(self, source: Computation, key: Callable[[Handle], Fields], partitions: int | None = None, **types):
        super().__init__(source, **types)
        self.key, self.partitions = key, partitions


class PartitionTransform(Partition):
    """The keys, dealt to partitions by key; the rest of the row is gone."""

    name = "partition_transform"
