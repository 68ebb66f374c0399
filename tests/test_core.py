"""Terms, graphs, plan text, sets, the matrix language and the learners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from setflow.functions import scalars as X
from setflow.functions.terms import native
from setflow.la import language
from setflow.la.matrix import Matrix, Shape, ShapeError
from setflow.ml import clustering
from setflow.operators.computations import Aggregate, Join, MultiSelect, Partition, Scan, Select, TopK, Write, count_of, exact_sum_of, sum_of
from setflow.plans.ir import parse_plan, print_plan, run_plan
from setflow.sources.catalog import SetStore
from setflow.sources.files import TPCH, read_tbl, read_triples, read_vectors
from setflow.streaming.sets import growing_set, run_added
from setflow.types import TypeRegistry
from setflow.workloads import nested, shapes, tpch


@pytest.fixture
def store(spark):
    own = SetStore(spark)
    own.attach_frame("d", "a", spark.createDataFrame([(1, "x", 1.5), (2, "y", 2.5), (2, "x", None), (None, "z", 4.0)], "k int, s string, v double"))
    own.attach_frame("d", "b", spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "k int, w int"))
    own.attach_frame("d", "none", spark.createDataFrame([], "k int, w int"))
    return own


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["revenue"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_wiring_checks_types():
    with pytest.raises(TypeError):
        Select(Scan("d", "a", out_type="A"), in_types=("B",))
    with pytest.raises(IndexError):
        Select(Scan("d", "a")).set_input(1, Scan("d", "b"))
    node = Join(Scan("d", "a"), Scan("d", "b"), where=None, fields=lambda a, b: a.itself())
    node.inputs[1] = None
    with pytest.raises(ValueError):
        node.wired()


def test_declared_types_are_checked(spark):
    types = TypeRegistry()
    types.register("A", "k INT, s STRING")
    with pytest.raises(TypeError):
        types.check("A", spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(TypeError):
        types.register("A", "k LONG")
    with pytest.raises(KeyError):
        types.method("A", "missing")


def test_shared_nodes_compile_once(store):
    from setflow.plans.compiler import Compiler

    base = Select(Scan("d", "a"), where=lambda a: a["k"] == 2)
    compiler = Compiler(store.read)
    assert compiler.compile(base) is compiler.compile(base)
    assert len(base.inputs[0].consumers) == 1


def test_join_kinds(store):
    key = Join(Scan("d", "a"), Scan("d", "b"), where=lambda a, b: a["k"] == b["k"], fields=lambda a, b: {"s": a["s"], "w": b["w"]})
    assert rows(store.frame(key)) == [("x", 10), ("x", 20), ("x", 21), ("y", 20), ("y", 21)]
    theta = Join(Scan("d", "a"), Scan("d", "b"), where=lambda a, b: (a["k"] == b["k"]) & (b["w"] > 20), fields=lambda a, b: {"s": a["s"], "w": b["w"]})
    assert rows(store.frame(theta)) == [("x", 21), ("y", 21)]
    plan = store.frame(key)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    every = Join(Scan("d", "a"), Scan("d", "b"), where=None, fields=lambda a, b: {"s": a["s"], "w": b["w"]})
    assert store.frame(every).count() == 16
    assert store.frame(Join(Scan("d", "a"), Scan("d", "none"), where=lambda a, b: a["k"] == b["k"], fields=lambda a, b: a.itself())).count() == 0


def test_folds_of_nothing_have_no_row(store):
    assert store.frame(Aggregate(Scan("d", "none"), None, lambda x: {"n": count_of()})).count() == 0
    assert rows(store.frame(Aggregate(Scan("d", "a"), None, lambda x: {"n": count_of(), "v": sum_of(x["v"])}))) == [(4, 8.0)]


def test_null_is_no_match(store):
    assert rows(store.frame(Select(Scan("d", "a"), where=lambda a: ~a["k"].same(2), fields=lambda a: {"s": a["s"]}))) == [("x",), ("z",)]


def test_multi_select_drops_empty(spark):
    own = SetStore(spark).attach_frame("d", "v", spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, v array<int>"))
    assert rows(own.frame(MultiSelect(Scan("d", "v"), many=lambda r: r["v"], keep=lambda r: {"k": r["k"]}))) == [(1, 1), (1, 2)]


def test_top_k_ties_and_partitions(store):
    best = TopK(Scan("d", "b"), 2, score=lambda b: b["k"], ties=lambda b: [b["w"]])
    assert [tuple(r) for r in store.frame(best).collect()] == [(3, 3, 30), (2, 2, 20)]
    assert store.frame(Partition(Scan("d", "b"), lambda b: {"k": b["k"]}, partitions=3)).rdd.getNumPartitions() == 3
    gathered = Aggregate(Scan("d", "b"), lambda b: {"k": b["k"]}, lambda b: {"n": count_of()}).set_collect_as_map(1)
    assert store.frame(gathered).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", list(shapes.GRAPHS))
def test_plan_text_of_every_shape(spark, small, name):
    """Printed, parsed and run, a graph gives what its direct compilation gives."""
    own = tpch.store(spark, small)
    plan = print_plan(Write(shapes.GRAPHS[name](), "out", "r"))
    again = parse_plan(str(plan), plan.library)
    assert str(again) == str(plan)
    got, want = run_plan(again, own.read)["out", "r"], own.frame(shapes.GRAPHS[name]())
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns)) == rows(want)


def test_plan_text_errors_and_case():
    assert parse_plan("/* note */ a(x) <= scan('d', 's', 'c')").statements[0].op == "SCAN"
    for bad in ("a(x) <= NOPE('d')", "a(x) SCAN('d')", "a(x) <= SCAN('d'", "a(x) <= SCAN(?)"):
        with pytest.raises(SyntaxError):
            parse_plan(bad)


@pytest.mark.parametrize("fields", [None, lambda b: {"twice": b["w"] + b["w"]}])
def test_plan_text_of_top_k(store, fields):
    """With and without fields of its own; ties are in the text too."""
    best = TopK(Scan("d", "b"), 2, score=lambda b: b["k"], fields=fields, ties=lambda b: [b["w"]])
    plan = print_plan(Write(best, "out", "r"))
    assert "AGGREGATE" in str(plan)
    got = run_plan(parse_plan(str(plan), plan.library), store.read)["out", "r"]
    assert rows(got.select(*store.frame(best).columns)) == rows(store.frame(best)) and got.count() == 2


def test_sets(spark, tmp_path):
    types = TypeRegistry()
    types.register("Pair", "k INT, s STRING")
    own = SetStore(spark, types)
    own.create_database("sf_test")
    try:
        own.create_set("sf_test", "pairs", "Pair")
        own.create_set("sf_test", "copy", "Pair")
        assert own.type_of("sf_test", "pairs") == "Pair"
        assert own.send_data("sf_test", "pairs", [(1, "a"), (2, "b"), (2, "b")]) == 3
        node = Select(Scan("sf_test", "pairs"), where=lambda p: p["k"] == 2).set_output("sf_test", "copy")
        own.execute(node, Write(node, "sf_test", "copy"))
        assert own.read("sf_test", "copy").count() == 4
        assert [r["k"] for r in own.iterate("sf_test", "pairs")].count(2) == 2
        own.partition_set("sf_test", "pairs", "by_k", "k", 2)
        assert own.sets("sf_test") == ["by_k", "copy", "pairs"] and "sf_test" in own.databases()
        for fmt in ("csv", "json", "parquet"):
            own.export("sf_test", "pairs", str(tmp_path / fmt), fmt)
        assert spark.read.json(str(tmp_path / "json")).count() == 3
        with pytest.raises(ValueError):
            own.export("sf_test", "pairs", str(tmp_path / "x"), "xml")
        assert "Provider" in own.statistics("sf_test", "pairs")
        assert own.place(own.read("sf_test", "pairs"), 3, "random").rdd.getNumPartitions() == 3
        own.clear_set("sf_test", "pairs")
        assert own.read("sf_test", "pairs").count() == 0
        own.remove_set("sf_test", "pairs")
        assert own.sets("sf_test") == ["by_k", "copy"]
    finally:
        own.remove_database("sf_test")


def test_joins_read_bucketed_copies(spark):
    """Two sets partitioned by the join key are joined without a shuffle, until one of them changes."""
    types = TypeRegistry()
    types.register("Pair", "k INT, s STRING")
    own = SetStore(spark, types)
    own.create_database("sf_copies")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("a", "b"):
            own.create_set("sf_copies", name, "Pair")
            own.send_data("sf_copies", name, [(k % 7, f"{name}{k}") for k in range(40)])
        join = lambda: own.frame(Join(Scan("sf_copies", "a"), Scan("sf_copies", "b"), where=lambda a, b: (a["k"] == b["k"]) & (a["s"] < b["s"]), fields=lambda a, b: {"x": a["s"], "y": b["s"]}))
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
        want = rows(join())
        assert shuffles(join()) == 2
        own.partition_set("sf_copies", "a", "a_by_k", "k", 3)
        own.partition_set("sf_copies", "b", "b_by_k", "k", 3)
        own.partition_set("sf_copies", "b", "b_keys", "k", 3, keys_only=True)
        assert shuffles(join()) == 0 and rows(join()) == want
        own.send_data("sf_copies", "a", [(3, "a99")])
        assert own.bucketed("sf_copies", "a", "k") is None and own.bucketed("sf_copies", "b", "k") is not None
        assert len(join().collect()) > len(want) and SetStore(spark, types).bucketed("sf_copies", "a", "k") is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        own.remove_database("sf_copies")


def test_bytes_of_rows(spark):
    import pyarrow as pa

    types = TypeRegistry()
    types.register("Pair", "k INT, s STRING")
    own = SetStore(spark, types)
    own.create_database("sf_bytes")
    try:
        own.create_set("sf_bytes", "pairs", "Pair")
        sink, table = pa.BufferOutputStream(), pa.table({"s": ["a", None], "k": pa.array([1, 2], pa.int32())})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        assert own.send_bytes("sf_bytes", "pairs", sink.getvalue().to_pybytes()) == 2
        own.flush("sf_bytes", "pairs")
        assert rows(own.read("sf_bytes", "pairs")) == [(1, "a"), (2, None)]
    finally:
        own.remove_database("sf_bytes")


def test_aggregate_without_combiner(store):
    def make():
        return Aggregate(Scan("d", "b"), lambda b: {"k": b["k"]}, lambda b: {"n": count_of(), "w": sum_of(b["w"])})

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    off = store.frame(make().set_using_combiner(False))
    assert rows(off) == rows(store.frame(make())) == [(1, 1, 10), (2, 2, 41), (3, 1, 30)]
    first = [line for line in plan(off).splitlines() if "Exchange" in line or "HashAggregate" in line]
    assert "HashAggregate" in first[0] and "Exchange" in first[-1]  # nothing is folded below the shuffle


def test_joins_take_keyed_inputs_first(store):
    """Keys only to the third input: no product of the first two."""
    three = Join(Scan("d", "a"), Scan("d", "b"), Scan("d", "b"), where=lambda a, b, c: (a["k"] == c["k"]) & (b["w"] == c["w"]), fields=lambda a, b, c: {"s": a["s"], "w": b["w"]})
    df = store.frame(three)
    assert rows(df) == [("x", 10), ("x", 20), ("x", 21), ("y", 20), ("y", 21)]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "Cross" not in plan


def test_distances_by_norms_and_rounding(spark):
    """Both ways of the distance, and the rounding test on both sides of zero."""
    data = [([1.0, 2.0], [4.0, 6.0]), ([1e8 + 1, 1e8], [1e8, 1e8]), ([1e6 + 0.1] * 64, [1e6] * 64), ([0.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(data, "a array<double>, b array<double>")
    near = X.distance_by_norms(F.col("a"), X.norm2(F.col("a")), F.col("b"), X.norm2(F.col("b")))
    got = [r[0] for r in df.select(near).collect()]
    assert np.allclose(got, [25.0, 1.0, 64 * ((1e6 + 0.1) - 1e6) ** 2, 0.0], rtol=1e-8, atol=0)
    values = [0.0, 0.4, 0.5, 1.49, 1.5, 7.99, -0.3, -0.7, -1.2, -1.5, -1.7, None]
    cut = lambda v, d: int(v / d)  # noqa: E731  towards zero
    want = [None if v is None else cut(int(v * 10) + 5, 10) == cut(int(v * 10), 10) for v in values]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(X.rounds_to_its_whole_part(F.col("x"))).collect()] == want
    assert True in want and False in want


def test_nested_objects_without_parts(spark, small):
    """A customer without orders and an order without lines stay, with empty arrays."""
    own = tpch.store(spark, small)
    t = {n: own.read("tpch", n) for n in ("customer", "orders", "lineitem", "supplier", "part")}
    t["lineitem"] = t["lineitem"].where("l_orderkey % 3 != 0")
    t["orders"] = t["orders"].where("o_custkey % 5 != 0")
    from setflow.sources.files import nested_customers

    found = nested_customers(**t)
    assert found.count() == t["customer"].count()
    assert found.where("size(orders) = 0").count() >= t["customer"].where("c_custkey % 5 = 0").count() > 0
    assert found.selectExpr("sum(size(orders))").first()[0] == t["orders"].count()


def test_files(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("0|AFRICA|a comment|\n1|ASIA||\n")
    assert rows(read_tbl(spark, str(tmp_path / "r.tbl"), TPCH["region"])) == [(0, "AFRICA", "a comment"), (1, "ASIA", None)]
    (tmp_path / "v").write_text("1 2.5\n\n3,4\n")
    assert rows(read_vectors(spark, str(tmp_path / "v"))) == [([1.0, 2.5],), ([3.0, 4.0],)]
    (tmp_path / "t").write_text("0 1 2\n")
    assert rows(read_triples(spark, str(tmp_path / "t"))) == [(0, 1, 2)]


def test_added_files_run_once(spark, tmp_path):
    source, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(5).write.parquet(source)
    for want in (3, 3, 6):
        if want == 6:
            spark.range(5).write.mode("append").parquet(source)
        node = Select(Scan("d", "s"), where=lambda x: x["id"] >= 2)
        run_added(node, {("d", "s"): growing_set(spark, source, spark.range(1).schema)}, target, checkpoint)
        assert spark.read.parquet(target).count() == want


def test_scalars(spark):
    df = spark.createDataFrame([("ring", "small ring", [1, 2, 2], [3.0, 4.0])], "a string, b string, c array<int>, v array<double>")
    got = df.select(
        X.ends_with(F.col("a"), "ring"), X.ends_with(F.col("a"), "ring", strict=True), X.contains_in_order(F.col("b"), "ll", "l"), X.contains_in_order(F.col("b"), "sm", "ring"), F.round(X.jaccard(F.col("c"), [2, 3]), 6), X.norm2(F.col("v")),
        X.one_hot(3, F.lit(1), F.lit(5).cast("long")), X.vector_divide(F.col("v"), F.lit(2.0)), X.filled(2, 1.0), X.vector_add(F.col("v"), F.col("v")),
    ).first()
    assert tuple(got) == (True, False, False, True, round(1 / 3, 6), 5.0, [0, 5, 0], [1.5, 2.0], [1.0, 1.0], [6.0, 8.0])
    assert X.sampling_fraction(10, 5) == 1.0 and 0.1 < X.sampling_fraction(100, 1000) < 0.2 and X.sampling_fraction(1, 0) == 1.0


def dense(m):
    out = np.zeros((m.shape.height, m.shape.width))
    for r in m.cells().collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_matrix_language(spark, tmp_path):
    (tmp_path / "m").write_text("0 0 1 2 3 4 5 6\n1 0 7 8 9 1 2 4\n")
    own = language.Program(spark).run(
        f'X = load(2,3,2,1,"{tmp_path}/m")\nG = X \'* X\nI = G^-1 %*% G\nR = rowMax(X) C = colMin(X)\nM = max(X)\nD = X - duplicateRow(C, 2, 2)\nE = X + X * X\nT = duplicateCol(rowSum(X), 3, 1)\nN = min(X)\nZ = zeros(1,1,2,2) O = identity(2, 2)'
    )
    x = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9], [1, 2, 4]], float)
    for name, want in {"X": x, "G": x.T @ x, "I": np.eye(3), "R": x.max(axis=1, keepdims=True), "C": x.min(axis=0, keepdims=True), "M": [[9]], "D": x - x.min(axis=0), "E": x + x * x, "T": np.repeat(x.sum(axis=1, keepdims=True), 3, axis=1), "N": [[1]], "Z": np.zeros((2, 2)), "O": np.eye(4)}.items():
        assert np.allclose(dense(own[name]), want), name
    assert tuple(own["M"].df.select("row", "col").first()) == (2, 2) and tuple(own["N"].df.select("row", "col").first()) == (0, 0)
    assert language.parse("K = A + B%*%C")[0][1].op == "+"
    assert language.parse("K = A^T '* B")[0][1].op == "'*"
    with pytest.raises(NameError):
        own.run("X = ones(1,1,1,1)")
    with pytest.raises(ShapeError):
        own.run("Q = X %*% X")
    with pytest.raises(SyntaxError):
        language.parse("max = A")
    with pytest.raises(ShapeError):
        Matrix.constant(spark, Shape(2, 3, 1, 1), 1.0).inverse()


def test_kmeans_and_mixture(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (4, 4), (0, 5))])
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, x array<double>")
    start = np.array([[0.5, 0.5], [3.0, 3.0], [0.0, 4.0]])
    found, done = clustering.kmeans(df, start)
    want = start
    for _ in range(done):
        best = ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[best == k].mean(axis=0) for k in range(3)])
    assert np.allclose(found, want)
    model, history = clustering.fit_mixture(df, clustering.Mixture(np.full(3, 1 / 3), start, np.array([np.eye(2)] * 3)), rounds=6)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and np.allclose(sorted(model.weights), 1 / 3, atol=0.02)
    assert clustering.sample_points(df, 5, "id").shape == (5, 2)
    with pytest.raises(ValueError):
        clustering.sample_points(df, 500, "id")


def test_native_terms_and_exact_sums(store):
    got = store.frame(Aggregate(Scan("d", "a"), lambda a: {"s": a["s"]}, lambda a: {"v": exact_sum_of(native(lambda x: x * 2, a["v"]))}))
    assert rows(got) == [("x", 3.0), ("y", 5.0), ("z", 8.0)]


def test_supervisors(spark):
    df = nested.supervisors(spark, 3)
    assert df.select(F.size("myGuys"), "me.department").collect()[1] == (10, "BCDE")


@pytest.mark.parametrize("n", [53, 116])
def test_matrices_have_every_row(spark, tmp_path, n):
    """Row numbers that fill no whole blocks, and ids with gaps that don't start at 0."""
    from setflow.workloads import matrices

    a = np.random.default_rng(n).integers(-900, 900, (n, 64)).astype(float)
    data = [(7 + 3 * i, (a[i] / 1000).tolist()) for i in range(n)]
    spark.createDataFrame(data[::-1], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {q: {(r["i"], r["j"]): r["v"] for r in matrices.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("la_row_sum", "la_tmul_gram", "la_transpose")}
    for q, want in (("la_row_sum", a.sum(axis=1)[:, None]), ("la_tmul_gram", a.T @ a), ("la_transpose", a.T)):
        assert got[q] == {(i, j): v for i, row in enumerate(want.tolist()) for j, v in enumerate(row)}, q
    best = matrices.QUERIES["la_max_elem"](spark, str(tmp_path)).collect()
    assert best[0]["v"] == a.max() and (best[0]["row"], best[0]["col"]) == divmod(int(a.argmax()), 64)


def test_chains_of_products(spark, monkeypatch):
    """A chain makes no matrix that is larger than its factors need; both ways of pairing blocks give the product."""
    from setflow.la import matrix

    a = np.random.default_rng(3).integers(-9, 9, (40, 4)).astype(float)
    df = spark.createDataFrame([(i, row) for i, row in enumerate(a.tolist())], "i long, x array<double>")
    made, product = [], Matrix._product
    monkeypatch.setattr(Matrix, "_product", lambda *args: made.append(args[-1]) or product(*args))
    for small in (matrix.SMALL_CELLS, 0):
        monkeypatch.setattr(matrix, "SMALL_CELLS", small)
        own = language.Program(spark, A=Matrix.from_rows(df, Shape(5, 2, 8, 2)))
        own.run("L = A %*% A^T %*% A\nR = A^T %*% (A %*% A^T)\nG = A '* A\nO = A %*% A^T")
        for name, want in {"L": a @ a.T @ a, "R": a.T @ a @ a.T, "G": a.T @ a, "O": a @ a.T}.items():
            assert (dense(own[name]) == want).all(), name
    assert [s.height * s.width for s in made[:2]] == [16, 160]
    with pytest.raises(ShapeError):
        own.run("Q = A %*% A^T %*% A^T")


def test_sums_of_blocks_over_batches():
    """A block whose rows lie in several batches has one sum."""
    import pandas as pd

    from setflow.la.matrix import _adder

    keys = [(0, 0), (0, 0), (0, 1), (1, 0), (1, 0), (1, 0), (2, 0)]
    frame = pd.DataFrame({"bi": [k[0] for k in keys], "bj": [k[1] for k in keys], "data": [np.array([i, 1.0]) for i in range(len(keys))]})
    for n in range(1, 8):
        out = pd.concat(_adder(2)(frame[i : i + n] for i in range(0, len(keys), n)))
        assert [(r.bi, r.bj, *r.data) for r in out.itertuples()] == [(0, 0, 1, 2), (0, 1, 2, 1), (1, 0, 12, 3), (2, 0, 6, 1)]


def test_joins_of_many_with_many_are_dealt(spark, monkeypatch):
    """A key that all rows share makes its pairs in many tasks; the pairs are those of a plain join, nulls, repeated rows and key types included."""
    from collections import Counter

    from setflow.plans import compiler

    a = [(i, None if i % 50 == 0 else i % 3 if i > 900 else 7, float(i % 2)) for i in range(1000)]
    b = [(i, None if i % 40 == 0 else i % 5 if i > 350 else 7, float(i % 2)) for i in range(400)] * 2
    own = SetStore(spark).attach_frame("d", "a", spark.createDataFrame(a, "i int, k int, f double").coalesce(1))
    own.attach_frame("d", "b", spark.createDataFrame(b, "j long, k long, f double").coalesce(1)).attach_frame("d", "m", spark.createDataFrame([(1, {1: 2})] * 9, "k int, m map<int,int>"))
    want = Counter((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[2] <= y[2])
    join = lambda many: Join(Scan("d", "a"), Scan("d", "b"), where=lambda x, y: (x["k"] == y["k"]) & native(lambda p, q: p <= q, x["f"], y["f"]), fields=lambda x, y: {"i": x["i"], "j": y["j"]}, many=many)
    alike = Join(own_scan := Scan("d", "a"), own_scan, where=lambda x, y: x["k"] == y["k"], fields=lambda x, y: {"i": x["i"], "j": y["i"]}, many=True)
    maps = Join(Scan("d", "m"), Scan("d", "m"), where=lambda x, y: x["k"] == y["k"], fields=lambda x, y: {"x": x.itself(), "k": y["k"]}, many=True)
    assert Counter(map(tuple, own.frame(join(True)).collect())) == want  # few pairs: as before
    monkeypatch.setattr(compiler, "TASK_PAIRS", 10_000)
    monkeypatch.setattr(compiler, "PIECE_ROWS", 64)
    for most in (compiler.BROADCAST_KEYS, 0):
        monkeypatch.setattr(compiler, "BROADCAST_KEYS", most)
        got = own.frame(join(True))
        each = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(each) == want.total() and max(each) < want.total() / 8
        assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, own.frame(alike).collect())) == Counter((x[0], y[0]) for x in a for y in a if x[1] is not None and x[1] == y[1])
    monkeypatch.setattr(compiler, "TASK_PAIRS", 10)
    assert own.frame(maps).count() == 81
    with pytest.raises(ValueError):
        Join(Scan("d", "a"), Scan("d", "a"), Scan("d", "b"), where=None, fields=lambda *x: {}, many=True)


@pytest.mark.parametrize("name", ["join_object_key", "join_computed_key", "join_self"])
def test_queries_of_many_with_many(spark, small, monkeypatch, name):
    """Dealt in pieces they make the same rows, in several tasks."""
    from setflow.plans import compiler
    from tests.oracle import check

    folder = small.replace("sf0.001", "sf0.01")
    monkeypatch.setattr(compiler, "TASK_PAIRS", 100)
    monkeypatch.setattr(compiler, "PIECE_ROWS", 4)
    assert shapes.QUERIES[name](spark, folder).select(F.spark_partition_id()).distinct().count() > 1
    check(spark, folder, shapes.QUERIES[name], shapes.ORACLE[name])


def test_nested_queries_hold_what_they_read(spark, small):
    """Only the fields that are read are gathered in nested objects; none of the objects is lost."""
    whole, cut = (nested.store(spark, small, f).read(nested.DB, "customers") for f in (None, nested.READS["nested_supplier_parts"]))
    kept = {f.name: f.dataType for f in cut.schema.fields}
    order = kept["orders"].elementType
    assert list(kept) == ["c_name", "orders"] and order.names == ["lines"] and order["lines"].dataType.elementType.simpleString() == "struct<supplier:struct<s_name:string>,part:struct<p_partkey:bigint>>"
    n = lambda df: df.agg(F.count("*"), F.sum(F.size("orders")), F.sum(F.size(F.flatten("orders.lines")))).first()
    assert n(whole) == n(cut)


def test_topics_in_shards(spark, monkeypatch):
    """Words dealt to many shards keep every occurrence, repeated triples too, and draws don't depend on how rows are dealt; two kinds of documents get two topics."""
    from setflow.ml import topics

    triples = [(d, w + 10 * (d % 2), 3) for d in range(40) for w in range(10)] + [(0, 0, 2)]
    df = spark.createDataFrame(triples, "doc_id long, word_id int, n int")
    monkeypatch.setattr(topics, "SHARD_WORDS", 3)
    keep = lambda x: x.localCheckpoint()
    docs, words, assigned = topics.lda(df, 2, rounds=1, seed=4, keep=keep)
    whole = {(r["doc_id"], r["word_id"]): r["n"] for r in assigned.groupBy("doc_id", "word_id").agg(F.sum("n").alias("n")).collect()}
    assert whole == {(d, w): 5 if (d, w) == (0, 0) else n for d, w, n in triples[:-1]}
    assert np.allclose([sum(r["p"]) for r in docs.collect()], 1) and np.allclose(np.sum([r["p"] for r in words.collect()], axis=0), 1)
    monkeypatch.setattr(topics, "SHARD_WORDS", 1 << 15)
    again = topics.lda(df.repartition(7), 2, rounds=1, seed=4, keep=keep, vocabulary=df.select("word_id").distinct())[2]
    assert rows(again) == rows(assigned)
    docs, _, _ = topics.lda(df, 2, rounds=15, seed=4, keep=keep)
    p = {r["doc_id"]: r["p"][0] for r in docs.collect()}
    assert abs(np.mean([p[d] for d in range(0, 40, 2)]) - np.mean([p[d] for d in range(1, 40, 2)])) > 0.6


@pytest.mark.parametrize("shape", [0.3, 1.0, 5.5, 400.0])
def test_gamma_draws(shape):
    from setflow.ml import topics

    x = topics.gammas(3, 1, topics.WORDS, np.arange(40000), np.full((40000, 2), shape))
    assert np.allclose(x.mean(axis=0), shape, rtol=0.05) and np.allclose(x.var(axis=0), shape, rtol=0.08)
    assert abs(np.corrcoef(x.T)[0, 1]) < 0.02
    assert (topics.gammas(3, 1, topics.WORDS, np.array([7]), np.full((1, 2), shape)) == x[7]).all()


def test_words_packed_over_batches():
    import pyarrow as pa

    from setflow.ml import topics

    data = [(1, 0, 5, 1), (1, 0, 5, 2), (1, 0, 6, 1), (1, 1, 3, 1), (2, 1, 3, 1), (2, 1, 3, 4), (2, 1, 9, 1), (3, 0, 1, 1)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for n in range(1, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*data[i : i + n]), kinds)], ["doc_id", "shard", "word_id", "n"]) for i in range(0, 8, n)]
        got = [tuple(r.values()) for b in topics._packed(iter(batches)) for r in b.to_pylist()]
        assert got == [(1, 0, [5, 6], [3, 1]), (1, 1, [3], [1]), (2, 1, [3, 9], [5, 1]), (3, 0, [1], [1])]
