"""One query for each operator shape: scans, selections, joins, folds, top-k, partitions, strings and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.functions import scalars as X
from setflow.functions.terms import native
from setflow.operators.computations import Aggregate, Computation, Fold, Join, MultiSelect, Partition, PartitionTransform, Scan, Select, TopK, avg_of, count_of, exact_sum_of, fold, list_of, max_of, min_of
from setflow.types import REGISTRY
from setflow.workloads.shared import drawn
from setflow.workloads.tpch import DB, A, D, S, graph_query, scan

REGISTRY.register("Customer", None, balanceBand=lambda row: F.floor(row["c_acctbal"] / 1000).cast("long"), nationOf=lambda row: row["c_nationkey"])
REGISTRY.register("Supplier", None, balanceBand=lambda row: F.floor(row["s_acctbal"] / 1000).cast("long"), nationOf=lambda row: row["s_nationkey"])


def customers() -> Scan:
    return Scan(DB, "customer", out_type="Customer")


def suppliers() -> Scan:
    return Scan(DB, "supplier", out_type="Supplier")


def select_filter_project() -> Computation:
    return Select(scan("customer"), where=lambda c: c["c_mktsegment"] == "BUILDING", fields=lambda c: {"c_custkey": c["c_custkey"], "c_name": c["c_name"]})


def select_method_self() -> Computation:
    """A method term, and a whole object as the projection."""
    return Select(customers(), where=lambda c: (c.call("balanceBand") == 3) & (c["c_nationkey"] % 2 == 1), fields=lambda c: c.itself())


def multiselect_flatten() -> Computation:
    return MultiSelect(scan("embeddings"), where=lambda e: e["label"] == 1, many=lambda e: e["embedding"].apply(lambda v: F.transform(v, lambda x: x.cast("double"))), keep=lambda e: {"vec_id": e["vec_id"]}, element="x")


def join_equi2() -> Computation:
    return Join(scan("orders"), scan("customer"), where=lambda o, c: o["o_custkey"] == c["c_custkey"], fields=lambda o, c: {"o_orderkey": o["o_orderkey"], "c_name": c["c_name"]})


def join_equi3() -> Computation:
    return Join(
        scan("supplier"), scan("nation"), scan("region"), where=lambda s, n, r: (s["s_nationkey"] == n["n_nationkey"]) & (n["n_regionkey"] == r["r_regionkey"]), fields=lambda s, n, r: {"s_name": s["s_name"], "n_name": n["n_name"], "r_name": r["r_name"]}
    )


def join_computed_key() -> Computation:
    """Method results as keys, two of them."""
    return Join(customers(), suppliers(), where=lambda c, s: (c.call("balanceBand") == s.call("balanceBand")) & (c.call("nationOf") == s.call("nationOf")), fields=lambda c, s: {"c_custkey": c["c_custkey"], "s_suppkey": s["s_suppkey"]}, many=True)


def join_object_key() -> Computation:
    """Whole structs as keys."""
    key = lambda a, b: native(lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b")), a, b)
    return Join(scan("customer"), scan("supplier"), where=lambda c, s: key(c["c_nationkey"], c["c_custkey"] % 5) == key(s["s_nationkey"], s["s_suppkey"] % 5), fields=lambda c, s: {"c_custkey": c["c_custkey"], "s_suppkey": s["s_suppkey"]}, many=True)


def join_cross() -> Computation:
    """An opaque predicate over two small sets."""
    return Join(scan("nation"), scan("region"), where=lambda n, r: native(lambda a, b: a % 5 != b, n["n_nationkey"], r["r_regionkey"]), fields=lambda n, r: {"n_nationkey": n["n_nationkey"], "r_regionkey": r["r_regionkey"]})


def join_theta() -> Computation:
    """A key and a residual condition."""
    return Join(
        scan("lineitem"), scan("part"), where=lambda l, p: (l["l_partkey"] == p["p_partkey"]) & (l["l_extendedprice"] < p["p_retailprice"] * l["l_quantity"]), fields=lambda l, p: {"l_orderkey": l["l_orderkey"], "l_linenumber": l["l_linenumber"], "p_partkey": p["p_partkey"]}
    )


def join_scalar_agg() -> Computation:
    mean = Aggregate(scan("part"), None, lambda p: {"mean": fold(p["p_retailprice"], lambda c: F.sum(c.cast("decimal(18,4)")).cast("double") / F.count(c).cast("double"))})
    return Join(scan("part"), mean, where=lambda p, m: p["p_retailprice"] > m["mean"], fields=lambda p, m: {"p_partkey": p["p_partkey"]}, hints={1: "broadcast"})


def join_self() -> Computation:
    one = scan("supplier")
    return Join(one, one, where=lambda a, b: (a["s_nationkey"] == b["s_nationkey"]) & (a["s_suppkey"] < b["s_suppkey"]), fields=lambda a, b: {"a": a["s_suppkey"], "b": b["s_suppkey"]}, many=True)


def join_broadcast() -> Computation:
    """A side of fixed size, the nations, is sent to every task."""
    return Join(scan("customer"), scan("nation"), where=lambda c, n: c["c_nationkey"] == n["n_nationkey"], fields=lambda c, n: {"c_custkey": c["c_custkey"], "n_name": n["n_name"]}, hints={1: "broadcast"})


def join_shuffle_hash() -> Computation:
    return Join(scan("lineitem"), scan("orders"), where=lambda l, o: l["l_orderkey"] == o["o_orderkey"], fields=lambda l, o: {"l_orderkey": l["l_orderkey"], "l_linenumber": l["l_linenumber"], "l_partkey": l["l_partkey"], "o_custkey": o["o_custkey"]}, hints={1: "shuffle_hash"})


def agg_basic() -> Computation:
    return Aggregate(
        scan("orders"), lambda o: {"o_orderpriority": o["o_orderpriority"]}, lambda o: {"total": exact_sum_of(o["o_totalprice"]), "n": count_of(), "least": min_of(o["o_totalprice"]), "most": max_of(o["o_totalprice"])}
    )


def agg_avg() -> Computation:
    """Sum and count are kept beside the mean."""
    sums = Aggregate(scan("supplier"), lambda s: {"s_nationkey": s["s_nationkey"]}, lambda s: {"total": exact_sum_of(s["s_acctbal"]), "n": count_of()})
    return Select(sums, fields=lambda a: {"s_nationkey": a["s_nationkey"], "total": a["total"], "n": a["n"], "mean": a["total"] / a["n"]})


def agg_conditional() -> Computation:
    high = lambda x: x.apply(lambda c: F.when(c > 150000, 1).otherwise(0))
    return Aggregate(scan("orders"), lambda o: {"o_orderstatus": o["o_orderstatus"]}, lambda o: {"high": fold(high(o["o_totalprice"]), F.sum), "low": fold(1 - high(o["o_totalprice"]), F.sum)})


def agg_global_empty() -> Computation:
    """A fold of nothing has no row."""
    return Aggregate(Select(scan("orders"), where=lambda o: o["o_totalprice"] < -1.0), None, lambda o: {"n": count_of()})


def agg_of_agg() -> Computation:
    inner = Aggregate(scan("orders"), lambda o: {"o_custkey": o["o_custkey"]}, lambda o: {"n_orders": count_of()})
    return Aggregate(inner, lambda a: {"n_orders": a["n_orders"]}, lambda a: {"customers": count_of()})


def agg_vector_sum() -> Computation:
    """Vectors are summed by element in long form: one row for each position."""
    flat = MultiSelect(scan("embeddings"), many=lambda e: e["embedding"].apply(lambda v: F.transform(v, lambda x, i: F.struct(i.alias("pos"), x.cast("decimal(18,6)").alias("x")))), keep=lambda e: {"label": e["label"]})
    return Aggregate(flat, lambda r: {"label": r["label"], "pos": r["pos"]}, lambda r: {"x": fold(r["x"], lambda c: F.sum(c).cast("double"))})


def agg_map_of_lists() -> Computation:
    """Region -> {nation -> [suppliers]}: two groupings, then a row for each entry and member so that it can be compared."""
    joined = Join(scan("supplier"), scan("nation"), where=lambda s, n: s["s_nationkey"] == n["n_nationkey"], fields=lambda s, n: {"region": n["n_regionkey"], "nation": n["n_name"], "supplier": s["s_suppkey"]})
    lists = Aggregate(joined, lambda j: {"region": j["region"], "nation": j["nation"]}, lambda j: {"members": list_of(j["supplier"])})
    maps = Aggregate(lists, lambda a: {"region": a["region"]}, lambda a: {"nations": fold(native(lambda k, v: F.struct(k.alias("k"), v.alias("v")), a["nation"], a["members"]), lambda c: F.map_from_entries(F.collect_list(c)))})
    entries = MultiSelect(maps, many=lambda m: m["nations"].apply(F.map_entries), keep=lambda m: {"region": m["region"]})
    return MultiSelect(entries, many=lambda e: e["value"], keep=lambda e: {"region": e["region"], "nation": e["key"]}, element="supplier")


def agg_argmax() -> Computation:
    """The most expensive order of each priority; of equals the one of the least key."""
    best = lambda o: native(lambda p, k: F.struct(p.alias("price"), (-k).alias("k")), o["o_totalprice"], o["o_orderkey"])
    found = Aggregate(scan("orders"), lambda o: {"o_orderpriority": o["o_orderpriority"]}, lambda o: {"best": max_of(best(o))})
    return Select(found, fields=lambda a: {"o_orderpriority": a["o_orderpriority"], "price": a["best.price"], "o_orderkey": 0 - a["best.k"]})


def agg_filtered_avg() -> Computation:
    """A mean over some rows of each group, the others adding nothing."""
    some = lambda c: native(lambda b: F.when(b > 0, b), c["c_acctbal"])
    return Aggregate(scan("customer"), lambda c: {"c_nationkey": c["c_nationkey"]}, lambda c: {"total": exact_sum_of(some(c)), "n": count_of(some(c))})


def topk_l2(k: int = 10) -> Computation:
    """The nearest embeddings to the origin."""
    zero = F.array_repeat(F.lit(0.0), 64)
    return Select(
        TopK(scan("embeddings"), k, score=lambda e: e["embedding"].apply(lambda v: -F.round(X.squared_distance(v, zero), 6)), fields=lambda e: {"vec_id": e["vec_id"]}, ties=lambda e: [e["vec_id"]]), fields=lambda t: {"vec_id": t["vec_id"], "score": t["score"]}
    )


def partition_key() -> Computation:
    return Partition(scan("supplier"), key=lambda s: {"s_nationkey": s["s_nationkey"]}, partitions=8)


def partition_transform() -> Computation:
    return PartitionTransform(scan("lineitem"), key=lambda l: {"l_partkey": l["l_partkey"]}, partitions=8)


def strings() -> Computation:
    """Suffix, prefix, substring, ordered search, length, concatenation."""
    return Select(
        scan("part"),
        fields=lambda p: {
            "p_partkey": p["p_partkey"],
            "suffix": p["p_name"].apply(lambda x: X.ends_with(x, "ring")),
            "strict": p["p_name"].apply(lambda x: X.ends_with(x, "small ring", strict=True)),
            "prefix": p["p_type"].apply(lambda x: F.startswith(x, F.lit("PROMO"))),
            "head": p["p_name"].apply(lambda x: F.substring(x, 1, 2)),
            "ordered": p["p_name"].apply(lambda x: X.contains_in_order(x, "s", "ring")),
            "n": p["p_name"].apply(F.char_length),
            "label": native(lambda a, b: F.concat(a, F.lit("-"), b.cast("string")), p["p_brand"], p["p_size"]),
        },
    )


def vectors() -> Computation:
    """Products, norms and distances of embeddings to their own reversal; `fast` has norms that differ, `fast_far` both far from zero."""
    turned = F.reverse
    twice = lambda v: F.transform(F.reverse(v), lambda x: x.cast("double") * 2)
    far = lambda v: F.transform(v, lambda x: x.cast("double") + 1e6)
    return Select(
        scan("embeddings"),
        fields=lambda e: {
            "vec_id": e["vec_id"],
            "dot": e["embedding"].apply(lambda v: F.round(X.dot(v, turned(v)), 5)),
            "norm": e["embedding"].apply(lambda v: F.round(X.norm2(v), 5)),
            "distance": e["embedding"].apply(lambda v: F.round(X.squared_distance(v, turned(v)), 5)),
            "fast": e["embedding"].apply(lambda v: F.round(X.distance_by_norms(v, X.norm2(v), twice(v), X.norm2(twice(v))), 5)),
            "fast_far": e["embedding"].apply(lambda v: F.round(X.distance_by_norms(far(v), X.norm2(far(v)), far(turned(v)), X.norm2(far(turned(v)))), 5)),
        },
    )


def group_count(term) -> Fold:
    return fold(term, F.count)


def sampled(spark: SparkSession, sf_dir: str, least: int = 200, seed: int = 7) -> DataFrame:
    """A Bernoulli sample with the fraction that gives `least` rows at least; sampling is what this operator does."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fraction = X.sampling_fraction(least, df.count())
    return df.where(X.bernoulli(F.col("vec_id"), fraction, seed)).select("vec_id", "label")


def ir_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of four scans printed as text, parsed again and run."""
    from setflow.operators.computations import Write
    from setflow.plans.ir import parse_plan, print_plan, run_plan
    from setflow.workloads.tpch import q03, store

    plan = print_plan(Write(q03(), "out", "result"))
    again = parse_plan(str(plan), plan.library)
    return run_plan(again, store(spark, sf_dir).read)["out", "result"]


GRAPHS = {
    f.__name__: f
    for f in (
        select_filter_project, select_method_self, multiselect_flatten, join_equi2, join_equi3, join_computed_key, join_object_key, join_cross, join_theta, join_scalar_agg, join_self,
        join_broadcast, join_shuffle_hash, agg_basic, agg_avg, agg_conditional, agg_global_empty, agg_of_agg, agg_vector_sum, agg_map_of_lists, agg_argmax, agg_filtered_avg, topk_l2,
        partition_key, partition_transform, strings, vectors,
    )
}
QUERIES = {"scan_nation": graph_query(lambda: scan("nation")), **{k: graph_query(f) for k, f in GRAPHS.items()}, "ir_roundtrip": ir_roundtrip, "sampled": sampled}
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
ORACLE = {
    "scan_nation": "SELECT * FROM nation",
    "select_filter_project": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "select_method_self": "SELECT * FROM customer WHERE floor(c_acctbal / 1000) = 3 AND c_nationkey % 2 = 1",
    "multiselect_flatten": f"SELECT vec_id, unnest({_V}) AS x FROM embeddings WHERE label = 1",
    "join_equi2": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_equi3": "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_computed_key": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON floor(c_acctbal / 1000) = floor(s_acctbal / 1000) AND c_nationkey = s_nationkey",
    "join_object_key": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 5 = s_suppkey % 5",
    "join_cross": "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_nationkey % 5 <> r_regionkey",
    "join_theta": "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice < p_retailprice * l_quantity",
    "join_scalar_agg": f"SELECT p_partkey FROM part WHERE p_retailprice > (SELECT {A('p_retailprice')} FROM part)",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_broadcast": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_shuffle_hash": "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "agg_basic": f"SELECT o_orderpriority, {S('o_totalprice')} AS total, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1",
    "agg_avg": f"SELECT s_nationkey, {S('s_acctbal')} AS total, count(*) AS n, {S('s_acctbal')} / CAST(count(*) AS DOUBLE) AS mean FROM supplier GROUP BY 1",
    "agg_conditional": "SELECT o_orderstatus, CAST(count(*) FILTER (o_totalprice > 150000) AS BIGINT) AS high, CAST(count(*) FILTER (NOT o_totalprice > 150000) AS BIGINT) AS low FROM orders GROUP BY 1",
    "agg_global_empty": "SELECT count(*) AS n FROM orders WHERE o_totalprice < -1 HAVING count(*) > 0",
    "agg_of_agg": "SELECT n_orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) GROUP BY 1",
    "agg_vector_sum": "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, CAST(sum(CAST(x AS DECIMAL(18,6))) AS DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2",
    "agg_map_of_lists": "SELECT n_regionkey AS region, n_name AS nation, s_suppkey AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "agg_argmax": "SELECT o_orderpriority, o_totalprice AS price, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "agg_filtered_avg": f"SELECT c_nationkey, {S('CASE WHEN c_acctbal > 0 THEN c_acctbal END')} AS total, count(*) FILTER (c_acctbal > 0) AS n FROM customer GROUP BY 1",
    "topk_l2": f"SELECT vec_id, -round(list_sum(list_transform({_V}, lambda x: x * x)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
    "partition_key": "SELECT * FROM supplier",
    "partition_transform": "SELECT l_partkey FROM lineitem",
    "strings": """SELECT p_partkey, ends_with(p_name, 'ring') AS suffix, ends_with(p_name, 'small ring') AND length(p_name) > 10 AS strict, starts_with(p_type, 'PROMO') AS prefix, substr(p_name, 1, 2) AS head,
      instr(p_name, 's') > 0 AND instr(substr(p_name, instr(p_name, 's') + 1), 'ring') > 0 AS ordered, CAST(length(p_name) AS INTEGER) AS n, p_brand || '-' || CAST(p_size AS VARCHAR) AS label FROM part""",
    "sampled": f"""WITH f AS (SELECT 200.0::DOUBLE / count(*) AS share, -ln(0.0001::DOUBLE) / count(*) AS g FROM embeddings),
      q AS (SELECT least(1.0::DOUBLE, greatest(1e-10::DOUBLE, share + g + sqrt(g * g + 2 * g * share))) AS q FROM f)
      SELECT vec_id, label FROM embeddings WHERE {drawn('vec_id', 7)} < (SELECT q FROM q)""",
    "vectors": f"""WITH v AS (SELECT vec_id, {_V} AS a, list_reverse({_V}) AS b FROM embeddings)
      SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])), 5) AS dot, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 5) AS norm,
      round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS distance, round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - 2 * p[2]) * (p[1] - 2 * p[2]))), 5) AS fast,
      round(list_sum(list_transform(list_zip(a, b), lambda p: ((p[1] + 1000000) - (p[2] + 1000000)) * ((p[1] + 1000000) - (p[2] + 1000000)))), 5) AS fast_far FROM v""",
}
from setflow.workloads.tpch import ORACLE as _TPCH  # noqa: E402

ORACLE["ir_roundtrip"] = _TPCH["q03"]
__all__ = ["D", "GRAPHS", "ORACLE", "QUERIES", "avg_of"]
