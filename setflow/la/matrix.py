"""Matrices as tables of dense blocks, and the operations of the matrix language on them.

A block row is (bi, bj, rows, cols, data) with data in row-major order. Element-wise operations, transposes, reductions and
tilings are column expressions. Products run numpy on pairs of blocks, add up what a task makes before the
shuffle, and add the rest by block; a chain of products is taken in the order of the fewest multiplications. Only the
inverse gathers a matrix, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.functions.scalars import let

SCHEMA = "bi int, bj int, rows int, cols int, data array<double>"
#: The most cells of a matrix that is inverted in one task.
INVERSE_CELLS = 1 << 24
#: Sums of products that a task holds before it passes them on, in cells.
HELD_CELLS = 1 << 22
#: The most cells of a factor that every task gets whole.
SMALL_CELLS = 1 << 20


@dataclass(frozen=True)
class Shape:
    """Rows and columns of a block, and the numbers of block rows and block columns."""

    rows: int
    cols: int
    block_rows: int
    block_cols: int

    @property
    def height(self) -> int:
        return self.rows * self.block_rows

    @property
    def width(self) -> int:
        return self.cols * self.block_cols


class ShapeError(ValueError):
    pass


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


@dataclass
class Matrix:
    df: DataFrame
    shape: Shape

    # --- construction ---
    @staticmethod
    def constant(spark: SparkSession, shape: Shape, value: float) -> Matrix:
        n = spark.range(shape.block_rows * shape.block_cols)
        df = n.select(
            F.floor(F.col("id") / shape.block_cols).cast("int").alias("bi"), (F.col("id") % shape.block_cols).cast("int").alias("bj"), F.lit(shape.rows).alias("rows"), F.lit(shape.cols).alias("cols"), F.array_repeat(F.lit(float(value)), shape.rows * shape.cols).alias("data")
        )
        return Matrix(df, shape)

    @staticmethod
    def identity(spark: SparkSession, size: int, blocks: int) -> Matrix:
        shape = Shape(size, size, blocks, blocks)
        df = Matrix.constant(spark, shape, 0.0).df
        unit = F.transform(_upto(size * size), lambda k: F.when(k % (size + 1) == 0, 1.0).otherwise(0.0))
        return Matrix(df.withColumn("data", F.when(F.col("bi") == F.col("bj"), unit).otherwise(F.col("data"))), shape)

    @staticmethod
    def load(spark: SparkSession, path: str, shape: Shape) -> Matrix:
        """Lines `i j v v v ...`, one for each block."""
        p = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
        rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
        data = F.transform(F.slice("p", 3, F.size("p") - 2), lambda x: x.cast("double"))
        want = shape.rows * shape.cols
        checked = F.when(F.size(data) == want, data).otherwise(F.raise_error(F.lit(f"a block of {path} doesn't have {want} values")).cast("array<double>"))
        return Matrix(rows.select(F.col("p")[0].cast("int").alias("bi"), F.col("p")[1].cast("int").alias("bj"), F.lit(shape.rows).alias("rows"), F.lit(shape.cols).alias("cols"), checked.alias("data")), shape)

    @staticmethod
    def from_cells(cells: DataFrame, shape: Shape) -> Matrix:
        """From (i, j, v) with every cell present."""
        r, c = shape.rows, shape.cols
        keyed = cells.select(F.floor(F.col("i") / r).cast("int").alias("bi"), F.floor(F.col("j") / c).cast("int").alias("bj"), F.struct((F.col("i") % r).alias("a"), (F.col("j") % c).alias("b"), F.col("v").cast("double").alias("v")).alias("x"))
        df = keyed.groupBy("bi", "bj").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("data"))
        return Matrix(df.select("bi", "bj", F.lit(r).alias("rows"), F.lit(c).alias("cols"), "data"), shape)

    @staticmethod
    def from_rows(rows: DataFrame, shape: Shape) -> Matrix:
        """From (i, x) with every row present, x an array of all its cells."""
        r, c = shape.rows, shape.cols
        parts = F.transform(_upto(shape.block_cols), lambda j: F.slice("x", j * c + 1, F.lit(c)))
        cut = rows.select(F.floor(F.col("i") / r).cast("int").alias("bi"), (F.col("i") % r).alias("a"), F.posexplode(parts).alias("bj", "v"))
        df = cut.groupBy("bi", "bj").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("a", "v"))), lambda x: x["v"])).alias("data"))
        return Matrix(df.select("bi", "bj", F.lit(r).alias("rows"), F.lit(c).alias("cols"), "data"), shape)

    def cells(self) -> DataFrame:
        """(i, j, v) of every cell; for comparison and small results."""
        flat = self.df.select("bi", "bj", "rows", "cols", F.posexplode("data").alias("pos", "v"))
        return flat.select((F.col("bi") * self.shape.rows + F.floor(F.col("pos") / F.col("cols"))).cast("long").alias("i"), (F.col("bj") * self.shape.cols + F.col("pos") % F.col("cols")).cast("long").alias("j"), "v")

    # --- element-wise ---
    def _zip(self, other: Matrix, f: Callable[[Column, Column], Column], name: str) -> Matrix:
        if self.shape != other.shape:
            raise ShapeError(f"{name}: {self.shape} and {other.shape}")
        b = other.df.select("bi", "bj", F.col("data").alias("other"))
        return Matrix(self.df.join(b, ["bi", "bj"]).select("bi", "bj", "rows", "cols", F.zip_with("data", "other", f).alias("data")), self.shape)

    def __add__(self, other: Matrix) -> Matrix:
        return self._zip(other, lambda a, b: a + b, "add")

    def __sub__(self, other: Matrix) -> Matrix:
        return self._zip(other, lambda a, b: a - b, "subtract")

    def __mul__(self, other: Matrix) -> Matrix:
        return self._zip(other, lambda a, b: a * b, "element-wise product")

    # --- products ---
    def multiply(self, other: Matrix) -> Matrix:
        s, o = self.shape, other.shape
        if s.cols != o.rows or s.block_cols != o.block_rows:
            raise ShapeError(f"multiply: {s} and {o}")
        return self._product(other, "bj", "bi", False, Shape(s.rows, o.cols, s.block_rows, o.block_cols))

    def transpose_multiply(self, other: Matrix) -> Matrix:
        """transpose(self) times other."""
        s, o = self.shape, other.shape
        if s.rows != o.rows or s.block_rows != o.block_rows:
            raise ShapeError(f"transpose multiply: {s} and {o}")
        return self._product(other, "bi", "bi", True, Shape(s.cols, o.cols, s.block_cols, o.block_cols))

    def _product(self, other: Matrix, mine: str, theirs: str, turn: bool, shape: Shape) -> Matrix:
        left = self.df.select(F.col(mine).alias("k"), F.col("bj" if turn else "bi").alias("bi"), F.col("data").alias("a"))
        right = other.df.select(F.col(theirs).alias("k"), F.col("bj"), F.col("data").alias("b"))
        own, its = (self.shape.rows, self.shape.cols), (other.shape.rows, other.shape.cols)
        part = self._paired(left, right, other, turn).select("bi", "bj", "a", "b").mapInPandas(_multiplier(own, its, turn), "bi int, bj int, data array<double>")
        size = shape.rows * shape.cols
        whole = part.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInPandas(_adder(size), "bi int, bj int, data array<double>")
        return Matrix(whole.select("bi", "bj", F.lit(shape.rows).alias("rows"), F.lit(shape.cols).alias("cols"), "data"), shape)

    def _paired(self, left: DataFrame, right: DataFrame, other: Matrix, turn: bool) -> DataFrame:
        """The blocks that meet. A small factor goes to all tasks; else, where the factors share few blocks, the larger one is dealt further and the other copied."""
        own, its = self.shape.height * self.shape.width, other.shape.height * other.shape.width
        if min(own, its) <= SMALL_CELLS:
            return left.join(F.broadcast(right), "k") if its <= own else F.broadcast(left).join(right, "k")
        shared, rest = (self.shape.block_rows, self.shape.block_cols) if turn else (self.shape.block_cols, self.shape.block_rows)
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = min(-(-tasks // shared), rest if own >= its else other.shape.block_cols)
        dealt, copied = F.pmod("bi" if own >= its else "bj", F.lit(pieces)), F.explode(_upto(pieces))
        return left.withColumn("piece", dealt if own >= its else copied).join(right.withColumn("piece", copied if own >= its else dealt), ["k", "piece"])

    # --- transpose and inverse ---
    def transpose(self) -> Matrix:
        s = self.shape
        turned = let(F.col("data"), lambda d: F.transform(_upto(s.rows * s.cols), lambda k: F.get(d, (k % s.rows * s.cols + F.floor(k / s.rows)).cast("int"))))
        return Matrix(self.df.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.col("cols").alias("rows"), F.col("rows").alias("cols"), turned.alias("data")), Shape(s.cols, s.rows, s.block_cols, s.block_rows))

    def inverse(self) -> Matrix:
        s = self.shape
        if s.height != s.width:
            raise ShapeError(f"inverse: {s} is not square")
        if s.height * s.width > INVERSE_CELLS:
            raise ShapeError(f"inverse: over {INVERSE_CELLS} cells")
        df = self.df.groupBy(F.lit(0).alias("one")).applyInPandas(_inverter(s), SCHEMA)
        return Matrix(df, Shape(s.cols, s.rows, s.block_cols, s.block_rows))

    # --- reductions ---
    def _extreme(self, largest: bool) -> Matrix:
        """One cell, beside the row and column where it stands; of equals the first by row, then column."""
        value = (F.array_max if largest else F.array_min)("data")
        pos = F.array_position("data", value) - 1
        row, col = F.col("bi") * self.shape.rows + F.floor(pos / F.col("cols")), F.col("bj") * self.shape.cols + pos % F.col("cols")
        # within a block the first in row order; over blocks the least of (row, col)
        best = self.df.select(F.struct((value if largest else -value).alias("v"), (-row).alias("r"), (-col).alias("c")).alias("x")).agg(F.max("x").alias("x"))
        sign = F.col("x.v") if largest else -F.col("x.v")
        df = best.select(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), F.array(sign).alias("data"), (-F.col("x.r")).cast("long").alias("row"), (-F.col("x.c")).cast("long").alias("col"))
        return Matrix(df, Shape(1, 1, 1, 1))

    def max(self) -> Matrix:
        return self._extreme(True)

    def min(self) -> Matrix:
        return self._extreme(False)

    def _by(self, rows: bool, how: str) -> Matrix:
        s = self.shape
        reduce = {"max": F.array_max, "min": F.array_min, "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)}[how]
        if rows:
            local = let(F.col("data"), lambda d: F.transform(_upto(s.rows), lambda i: reduce(F.slice(d, i * s.cols + 1, F.lit(s.cols)))))
        else:
            local = let(F.col("data"), lambda d: F.transform(_upto(s.cols), lambda j: reduce(F.transform(_upto(s.rows), lambda i: F.get(d, i * s.cols + j)))))
        key = "bi" if rows else "bj"
        agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
        flat = self.df.select(key, F.posexplode(local).alias("pos", "v")).groupBy(key, "pos").agg(agg("v").alias("v"))
        packed = flat.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("data"))
        if rows:
            return Matrix(packed.select("bi", F.lit(0).alias("bj"), F.lit(s.rows).alias("rows"), F.lit(1).alias("cols"), "data"), Shape(s.rows, 1, s.block_rows, 1))
        return Matrix(packed.select(F.lit(0).alias("bi"), "bj", F.lit(1).alias("rows"), F.lit(s.cols).alias("cols"), "data"), Shape(1, s.cols, 1, s.block_cols))

    def row_max(self) -> Matrix:
        return self._by(True, "max")

    def row_min(self) -> Matrix:
        return self._by(True, "min")

    def row_sum(self) -> Matrix:
        return self._by(True, "sum")

    def col_max(self) -> Matrix:
        return self._by(False, "max")

    def col_min(self) -> Matrix:
        return self._by(False, "min")

    def col_sum(self) -> Matrix:
        return self._by(False, "sum")

    # --- tilings ---
    def duplicate_row(self, rows: int, block_rows: int) -> Matrix:
        s = self.shape
        if s.height != 1:
            raise ShapeError(f"duplicateRow: {s} is not a row")
        tiled = F.flatten(F.array_repeat(F.col("data"), rows))
        df = self.df.select(F.explode(_upto(block_rows)).alias("bi"), "bj", F.lit(rows).alias("rows"), "cols", tiled.alias("data"))
        return Matrix(df, Shape(rows, s.cols, block_rows, s.block_cols))

    def duplicate_col(self, cols: int, block_cols: int) -> Matrix:
        s = self.shape
        if s.width != 1:
            raise ShapeError(f"duplicateCol: {s} is not a column")
        tiled = F.flatten(F.transform("data", lambda x: F.array_repeat(x, cols)))
        df = self.df.select("bi", F.explode(_upto(block_cols)).alias("bj"), "rows", F.lit(cols).alias("cols"), tiled.alias("data"))
        return Matrix(df, Shape(s.rows, cols, s.block_rows, block_cols))


def _multiplier(a: tuple[int, int], b: tuple[int, int], turn: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"bi": [k[0] for k in sums], "bj": [k[1] for k in sums], "data": [v.ravel() for v in sums.values()]})

        for frame in frames:
            for i, j, x, y in zip(frame["bi"], frame["bj"], frame["a"], frame["b"]):
                left = np.asarray(x).reshape(a)
                product = (left.T if turn else left) @ np.asarray(y).reshape(b)
                key = (int(i), int(j))
                sums[key] = sums[key] + product if key in sums else product
                if len(sums) * product.size > HELD_CELLS:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    return run


def _adder(size: int):
    """Sums by block of rows that come in the order of blocks; a batch may end within a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            keys, data = frame[["bi", "bj"]].to_numpy(np.int32), np.stack(frame["data"].to_numpy()).reshape(-1, size)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            found, sums = keys[starts], np.add.reduceat(data, starts, axis=0)
            if held is not None and (held[0] == found[0]).all():
                sums[0] += held[1]
            elif held is not None:
                yield pd.DataFrame({"bi": [held[0][0]], "bj": [held[0][1]], "data": [held[1]]})
            held = found[-1], sums[-1].copy()
            if len(found) > 1:
                yield pd.DataFrame({"bi": found[:-1, 0], "bj": found[:-1, 1], "data": list(sums[:-1])})
        if held is not None:
            yield pd.DataFrame({"bi": [held[0][0]], "bj": [held[0][1]], "data": [held[1]]})

    return run


def _inverter(s: Shape):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((s.height, s.width))
        for i, j, x in zip(frame["bi"], frame["bj"], frame["data"]):
            whole[i * s.rows : (i + 1) * s.rows, j * s.cols : (j + 1) * s.cols] = np.asarray(x).reshape(s.rows, s.cols)
        turned = np.linalg.inv(whole)
        rows = [(i, j, s.cols, s.rows, turned[i * s.cols : (i + 1) * s.cols, j * s.rows : (j + 1) * s.rows].ravel()) for i in range(s.block_cols) for j in range(s.block_rows)]
        return pd.DataFrame(rows, columns=["bi", "bj", "rows", "cols", "data"])

    return run
