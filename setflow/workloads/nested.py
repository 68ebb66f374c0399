"""The workload over nested objects, and the employee fixtures of the object model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.functions.scalars import jaccard, rounds_to_its_whole_part
from setflow.functions.terms import native
from setflow.operators.computations import Aggregate, Computation, MultiSelect, Scan, Select, TopK, count_of, fold
from setflow.sources.catalog import SetStore
from setflow.sources.files import nested_customers
from setflow.types import REGISTRY

DB = "objects"
WANTED = (1, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597)
REGISTRY.register("Supervisor", "me STRUCT<name: STRING, age: INT, salary: DOUBLE, department: STRING>, myGuys ARRAY<STRUCT<name: STRING, age: INT, salary: DOUBLE, department: STRING>>")


def supervisors(spark: SparkSession, n: int = 1000) -> DataFrame:
    """Generated supervisors with ten reports each; by turns named alike or not."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    i = F.col("id").cast("int")
    department = F.concat(*(F.substring(F.lit(letters), F.pmod(i + k, F.lit(26)) + 1, F.lit(1)) for k in range(4)))
    me = F.struct(F.lit("Steve Stevens").alias("name"), (20 + i % 29).alias("age"), (i * F.lit(34.4)).alias("salary"), department.alias("department"))
    guys = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda j: F.struct(F.when(F.col("id") % 2 == 0, "Steve Stevens").otherwise("Albert Albertson").alias("name"), (20 + j % 29).alias("age"), (j * F.lit(3.54)).alias("salary"), department.alias("department")),
    )
    return spark.range(n).select(me.alias("me"), guys.alias("myGuys"))


#: The fields of nested customers that a query reads, where that isn't all: a collected array can't be cut down by the planner.
READS = {
    "nested_supplier_parts": ("c_name", "s_name", "p_partkey"),
    "nested_count_suppliers": ("c_name", "s_name", "p_partkey"),
    "topk_jaccard": ("c_custkey", "p_partkey"),
}


def store(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] | None = None) -> SetStore:
    own = SetStore(spark).attach("tpch", sf_dir)
    tables = {t: own.read("tpch", t) for t in ("customer", "orders", "lineitem", "supplier", "part")}
    own.attach_frame(DB, "customers", nested_customers(**tables, fields=fields))
    return own.attach_frame(DB, "supervisors", supervisors(spark))


def lines() -> Computation:
    """One row for each line that a customer bought: supplier, customer, part."""
    orders = MultiSelect(Scan(DB, "customers"), many=lambda c: c["orders"], keep=lambda c: {"customer": c["c_name"]})
    held = MultiSelect(orders, many=lambda o: o["lines"], keep=lambda o: {"customer": o["customer"]})
    return Select(held, fields=lambda l: {"supplier": l["supplier.s_name"], "customer": l["customer"], "part": l["part.p_partkey"]})


def nested_supplier_parts() -> Computation:
    """Supplier -> {customer -> [parts]}, then back to rows."""
    lists = Aggregate(lines(), lambda x: {"supplier": x["supplier"], "customer": x["customer"]}, lambda x: {"parts": fold(x["part"], lambda c: F.sort_array(F.collect_list(c)))})
    maps = Aggregate(lists, lambda x: {"supplier": x["supplier"]}, lambda x: {"sold": fold(native(lambda k, v: F.struct(k.alias("k"), v.alias("v")), x["customer"], x["parts"]), lambda c: F.map_from_entries(F.collect_list(c)))})
    entries = MultiSelect(maps, many=lambda m: m["sold"].apply(F.map_entries), keep=lambda m: {"supplier": m["supplier"]})
    return MultiSelect(entries, many=lambda e: e["value"], keep=lambda e: {"supplier": e["supplier"], "customer": e["key"]}, element="part")


def topk_jaccard(k: int = 20, wanted: tuple[int, ...] = WANTED) -> Computation:
    """The customers whose parts are most like a list."""
    bought = lambda c: c["orders"].apply(lambda o: F.array_distinct(F.flatten(F.transform(o, lambda x: F.transform(x["lines"], lambda l: l["part"]["p_partkey"])))))
    found = Select(Scan(DB, "customers"), fields=lambda c: {"c_custkey": c["c_custkey"], "bought": bought(c)})
    best = TopK(found, k, score=lambda c: c["bought"].apply(lambda b: F.round(jaccard(b, list(wanted)), 9)), fields=lambda c: {"c_custkey": c["c_custkey"]}, ties=lambda c: [c["c_custkey"]])
    return Select(best, fields=lambda t: {"c_custkey": t["c_custkey"], "score": t["score"]})


def nested_count() -> Computation:
    return Aggregate(Scan(DB, "customers"), None, lambda c: {"customers": count_of()})


def nested_count_suppliers() -> Computation:
    return Aggregate(Aggregate(lines(), lambda x: {"supplier": x["supplier"]}, lambda x: {"n": count_of()}), None, lambda a: {"suppliers": count_of()})


def same_name_guys() -> Computation:
    """Supervisors whose first report is named like them; a missing report is no match."""
    first = lambda s: s["myGuys"].apply(lambda g: F.get(g, 0)["name"])
    return Select(Scan(DB, "supervisors", out_type="Supervisor"), where=lambda s: first(s).same(s["me.name"]), fields=lambda s: {"department": s["me.department"], "age": s["me.age"], "salary": s["me.salary"]})


def department_totals() -> Computation:
    """Flattened reports of some supervisors, summed by department, then selected by a rounding test."""
    some = MultiSelect(Scan(DB, "supervisors", out_type="Supervisor"), where=lambda s: s["me.age"] < 40, many=lambda s: s["myGuys"])
    sums = Aggregate(some, lambda e: {"department": e["department"]}, lambda e: {"total": fold(e["salary"], lambda c: F.sum(c.cast("decimal(18,4)")).cast("double"))})
    return Select(sums, where=lambda t: native(rounds_to_its_whole_part, t["total"]))


def department_employees() -> Computation:
    """Department -> {supervisor -> [ages]}, as rows with sorted ages joined."""
    each = MultiSelect(Scan(DB, "supervisors"), many=lambda s: s["myGuys"], keep=lambda s: {"boss": s["me.name"]})
    lists = Aggregate(each, lambda e: {"department": e["department"], "boss": e["boss"]}, lambda e: {"ages": fold(e["age"], lambda c: F.sort_array(F.collect_list(c)))})
    return Select(lists, fields=lambda a: {"department": a["department"], "boss": a["boss"], "n": a["ages"].apply(lambda x: F.size(x).cast("long")), "least": a["ages"].apply(F.array_min), "most": a["ages"].apply(F.array_max)})


GRAPHS = {f.__name__: f for f in (nested_supplier_parts, topk_jaccard, nested_count, nested_count_suppliers, same_name_guys, department_totals, department_employees)}
QUERIES = {k: (lambda k, f: lambda spark, sf_dir: store(spark, sf_dir, READS.get(k)).frame(f()))(k, f) for k, f in GRAPHS.items()}
_LINES = "lines AS (SELECT s_name AS supplier, c_name AS customer, p_partkey AS part, c_custkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
_BOSSES = """bosses AS (SELECT i, CAST(20 + i % 29 AS INTEGER) AS age, i * 34.4::DOUBLE AS salary,
  chr(CAST(65 + i % 26 AS INTEGER)) || chr(CAST(65 + (i + 1) % 26 AS INTEGER)) || chr(CAST(65 + (i + 2) % 26 AS INTEGER)) || chr(CAST(65 + (i + 3) % 26 AS INTEGER)) AS department FROM range(1000) t(i))"""
_WANTED = "[" + ", ".join(f"{w}::BIGINT" for w in WANTED) + "]"
ORACLE = {
    "nested_supplier_parts": f"WITH {_LINES} SELECT supplier, customer, part FROM lines",
    "topk_jaccard": f"""WITH {_LINES}, b AS (SELECT customer.c_custkey, coalesce(list(DISTINCT part) FILTER (part IS NOT NULL), []) AS bought FROM customer LEFT JOIN lines ON customer.c_custkey = lines.c_custkey GROUP BY 1), s AS (SELECT c_custkey, len(bought) AS n, len(list_intersect(bought, {_WANTED})) AS common FROM b)
      SELECT c_custkey, round(CAST(common AS DOUBLE) / CAST(n + {len(WANTED)} - common AS DOUBLE), 9) AS score FROM s ORDER BY score DESC, c_custkey LIMIT 20""",
    "nested_count": "SELECT count(*) AS customers FROM customer HAVING count(*) > 0",
    "nested_count_suppliers": f"WITH {_LINES} SELECT count(DISTINCT supplier) AS suppliers FROM lines HAVING count(*) > 0",
    "same_name_guys": f"WITH {_BOSSES} SELECT department, age, salary FROM bosses WHERE i % 2 = 0",
    "department_totals": f"WITH {_BOSSES} SELECT * FROM (SELECT department, CAST(sum(CAST(j * 3.54::DOUBLE AS DECIMAL(18,4))) AS DOUBLE) AS total FROM bosses, range(10) r(j) WHERE age < 40 GROUP BY 1) WHERE CAST(trunc(total * 10) AS BIGINT) % 10 < 5",
    "department_employees": f"WITH {_BOSSES} SELECT department, 'Steve Stevens' AS boss, count(*) AS n, CAST(min(20 + j % 29) AS INTEGER) AS least, CAST(max(20 + j % 29) AS INTEGER) AS most FROM bosses, range(10) r(j) GROUP BY 1",
}
