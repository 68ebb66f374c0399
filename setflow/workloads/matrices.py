"""The matrix operations over the embeddings: 64 columns, all rows, in equal blocks of at most ROWS."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.la.language import Program
from setflow.la.matrix import Matrix, Shape
from setflow.workloads.shared import numbered

ROWS, COLS, WIDTH = 50, 16, 64


def row_numbers(df: DataFrame) -> DataFrame:
    """(i, embedding): rows numbered from 0 in the order of vec_id."""
    order = ("vec_id", "embedding")
    return numbered(df.select(*order), order, "i").select("i", "embedding")


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    """Whole numbers, so that sums are exact: thousandths of the embeddings. Blocks have as many rows as divide the number of all."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n, distinct, least, most = df.agg(F.count(F.lit(1)), F.count_distinct("vec_id"), F.min("vec_id"), F.max("vec_id")).first()
    dense = n == 0 or (distinct, least, most) == (n, 0, n - 1)
    numbered = df.select(F.col("vec_id").alias("i"), "embedding") if dense else row_numbers(df)
    rows = max(r for r in range(1, ROWS + 1) if n % r == 0)
    whole = numbered.select("i", F.transform("embedding", lambda v: F.round(v.cast("double") * 1000)).alias("x"))
    return Matrix.from_rows(whole, Shape(rows, COLS, n // rows, WIDTH // COLS))


def program(text: str, cells: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Program(spark, A=embeddings(spark, sf_dir)).run(text)["out"]
        if not cells:
            return found.df.select(F.col("data")[0].alias("v"), "row", "col")
        return found.cells().withColumn("v", F.col("v") + F.lit(0.0))  # no negative zero

    return run


_A = "A AS (SELECT i, CAST(pos - 1 AS BIGINT) AS j, round(CAST(v AS DOUBLE) * 1000) + 0.0::DOUBLE AS v FROM (SELECT i, unnest(embedding) AS v, unnest(range(1, 65)) AS pos FROM (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, embedding FROM embeddings)))"
_n = "(SELECT count(DISTINCT i) FROM A)"
PROGRAMS: dict[str, tuple[str, str]] = {
    "la_add": ("out = A + A", "SELECT i, j, v + v AS v FROM A"),
    "la_sub": ("out = A - (A + A)", "SELECT i, j, v - (v + v) AS v FROM A"),
    "la_scale_mul": ("out = A * A", "SELECT i, j, v * v AS v FROM A"),
    "la_matmul": ("out = A %*% A^T %*% A", "SELECT i, x.j, CAST(sum(A.v * x.v) AS DOUBLE) AS v FROM A JOIN (SELECT p.j AS k, q.j, sum(p.v * q.v) AS v FROM A p JOIN A q ON p.i = q.i GROUP BY 1, 2) x ON A.j = x.k GROUP BY 1, 2"),
    "la_tmul_gram": ("out = A '* A", "SELECT p.j AS i, q.j, sum(p.v * q.v) AS v FROM A p JOIN A q ON p.i = q.i GROUP BY 1, 2"),
    "la_transpose": ("out = A^T", "SELECT j AS i, i AS j, v FROM A"),
    "la_row_sum": ("out = rowSum(A)", "SELECT i, CAST(0 AS BIGINT) AS j, sum(v) AS v FROM A GROUP BY 1"),
    "la_row_max": ("out = rowMax(A)", "SELECT i, CAST(0 AS BIGINT) AS j, max(v) AS v FROM A GROUP BY 1"),
    "la_row_min": ("out = rowMin(A)", "SELECT i, CAST(0 AS BIGINT) AS j, min(v) AS v FROM A GROUP BY 1"),
    "la_col_sum": ("out = colSum(A)", "SELECT CAST(0 AS BIGINT) AS i, j, sum(v) AS v FROM A GROUP BY 2"),
    "la_col_max": ("out = colMax(A)", "SELECT CAST(0 AS BIGINT) AS i, j, max(v) AS v FROM A GROUP BY 2"),
    "la_col_min": ("out = colMin(A)", "SELECT CAST(0 AS BIGINT) AS i, j, min(v) AS v FROM A GROUP BY 2"),
    "la_dup_row": ("out = duplicateRow(colSum(A), 3, 2)", "SELECT r AS i, j, v FROM (SELECT j, sum(v) AS v FROM A GROUP BY 1), range(6) t(r)"),
    "la_dup_col": ("out = duplicateCol(rowSum(A), 3, 2)", "SELECT i, r AS j, v FROM (SELECT i, sum(v) AS v FROM A GROUP BY 1), range(6) t(r)"),
    "la_zeros": ("out = zeros(4, 3, 2, 2) + ones(4, 3, 2, 2)", "SELECT a AS i, b AS j, 1.0::DOUBLE AS v FROM range(8) x(a), range(6) y(b)"),
    "la_identity": ("out = identity(4, 3)", "SELECT a AS i, b AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(12) x(a), range(12) y(b)"),
}
EXTREMES = {
    "la_max_elem": ("out = max(A)", "SELECT v, i AS row, j AS col FROM A QUALIFY row_number() OVER (ORDER BY v DESC, i, j) = 1"),
    "la_min_elem": ("out = min(A)", "SELECT v, i AS row, j AS col FROM A QUALIFY row_number() OVER (ORDER BY v, i, j) = 1"),
}


def la_inverse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix times its inverse, rounded: the identity."""
    found = Program(spark, A=embeddings(spark, sf_dir)).run("B = A '* A + identity(16, 4)\nout = B^-1 %*% B")["out"].cells()
    return found.select("i", "j", F.abs(F.round("v", 4)).alias("v"))


QUERIES = {k: program(p) for k, (p, _) in PROGRAMS.items()} | {k: program(p, False) for k, (p, _) in EXTREMES.items()} | {"la_inverse_check": la_inverse_check}
ORACLE = {k: f"WITH {_A} {s}" for k, (_, s) in (PROGRAMS | EXTREMES).items()}
ORACLE["la_inverse_check"] = "SELECT a AS i, b AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) x(a), range(64) y(b)"
