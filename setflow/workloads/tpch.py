"""Ten decision-support queries as computation graphs.

They keep the semantics of the workload they reproduce, which differ from the standard in places (docstrings say
where; `spec=True` gives the standard form where the tables allow it). The tables at hand lack some columns, so
parameters name what stands for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.functions.scalars import as_iso
from setflow.functions.terms import native
from setflow.operators.computations import Aggregate, Computation, Fold, Join, Scan, Select, avg_of, count_of, exact_avg_of, exact_sum_of, fold, min_of
from setflow.sources.catalog import SetStore

DB = "tpch"


def day(text: str):
    """A typed literal, so that comparisons with it reach the scan."""
    return F.lit(text).cast("timestamp")


def store(spark: SparkSession, sf_dir: str) -> SetStore:
    return SetStore(spark).attach(DB, sf_dir)


def scan(name: str) -> Scan:
    return Scan(DB, name)


def q01() -> Computation:
    """Pricing summary by return flag and line status, over all lines."""
    return Aggregate(
        scan("lineitem"),
        keys=lambda l: {"l_returnflag": l["l_returnflag"], "l_linestatus": l["l_linestatus"]},
        folds=lambda l: {
            "sum_qty": exact_sum_of(l["l_quantity"]),
            "sum_base_price": exact_sum_of(l["l_extendedprice"]),
            "sum_disc_price": exact_sum_of(l["l_extendedprice"] * (1 - l["l_discount"])),
            "sum_charge": exact_sum_of(l["l_extendedprice"] * (1 - l["l_discount"]) * (1 + l["l_tax"]), 8),
            "avg_qty": exact_avg_of(l["l_quantity"]),
            "avg_price": exact_avg_of(l["l_extendedprice"]),
            "avg_disc": exact_avg_of(l["l_discount"]),
            "count_order": count_of(),
        },
    )


def q02(region: str = "EUROPE", size: int = 15, type_suffix: str = "SMALL") -> Computation:
    """Suppliers of least cost in a region; the least price a unit over the lines of part and supplier stands for the supply cost."""
    partsupp = Aggregate(scan("lineitem"), lambda l: {"ps_partkey": l["l_partkey"], "ps_suppkey": l["l_suppkey"]}, lambda l: {"ps_supplycost": min_of(l["l_extendedprice"] / l["l_quantity"])})
    part = Select(scan("part"), where=lambda p: (p["p_size"] == size) & p["p_type"].apply(lambda t: F.endswith(t, F.lit(type_suffix))))
    regions = Select(scan("region"), where=lambda r: r["r_name"] == region)
    nations = Join(scan("nation"), regions, where=lambda n, r: n["n_regionkey"] == r["r_regionkey"], fields=lambda n, r: {"n_nationkey": n["n_nationkey"], "n_name": n["n_name"]})
    suppliers = Join(scan("supplier"), nations, where=lambda s, n: s["s_nationkey"] == n["n_nationkey"], fields=lambda s, n: {"s_suppkey": s["s_suppkey"], "s_name": s["s_name"], "s_acctbal": s["s_acctbal"], "n_name": n["n_name"]})
    offers = Join(
        partsupp,
        part,
        suppliers,
        where=lambda ps, p, s: (ps["ps_partkey"] == p["p_partkey"]) & (ps["ps_suppkey"] == s["s_suppkey"]),
        fields=lambda ps, p, s: {"p_partkey": p["p_partkey"], "p_brand": p["p_brand"], "ps_supplycost": ps["ps_supplycost"], "s_name": s["s_name"], "s_acctbal": s["s_acctbal"], "n_name": s["n_name"]},
    )
    least = Aggregate(offers, lambda o: {"least_part": o["p_partkey"]}, lambda o: {"least_cost": min_of(o["ps_supplycost"])})
    return Join(offers, least, where=lambda o, m: (o["p_partkey"] == m["least_part"]) & (o["ps_supplycost"] == m["least_cost"]), fields=lambda o, m: o.itself())


def q03(segment: str = "BUILDING", date: str = "1998-03-15") -> Computation:
    """Revenue of orders not yet shipped; all orders, not the ten best."""
    customer = Select(scan("customer"), where=lambda c: c["c_mktsegment"] == segment)
    orders = Select(scan("orders"), where=lambda o: o["o_orderdate"] < day(date))
    lines = Select(scan("lineitem"), where=lambda l: l["l_shipdate"] > day(date))
    joined = Join(
        customer,
        orders,
        lines,
        where=lambda c, o, l: (c["c_custkey"] == o["o_custkey"]) & (l["l_orderkey"] == o["o_orderkey"]),
        fields=lambda c, o, l: {"o_orderkey": o["o_orderkey"], "o_orderdate": o["o_orderdate"].apply(as_iso), "o_orderpriority": o["o_orderpriority"], "price": l["l_extendedprice"] * (1 - l["l_discount"])},
    )
    return Aggregate(joined, lambda j: {k: j[k] for k in ("o_orderkey", "o_orderdate", "o_orderpriority")}, lambda j: {"revenue": exact_sum_of(j["price"])})


def q04(start: str = "1997-07-01", end: str = "1997-10-01") -> Computation:
    """Order lines by priority: each line counts, not each order."""
    orders = Select(scan("orders"), where=lambda o: (o["o_orderdate"] >= day(start)) & (o["o_orderdate"] < day(end)))
    joined = Join(orders, scan("lineitem"), where=lambda o, l: o["o_orderkey"] == l["l_orderkey"], fields=lambda o, l: {"o_orderpriority": o["o_orderpriority"]})
    return Aggregate(joined, lambda j: {"o_orderpriority": j["o_orderpriority"]}, lambda j: {"order_count": count_of()})


def q06(start: str = "1997-01-01", end: str = "1998-10-01", low: float = 0.05, high: float = 0.07, quantity: float = 24.0) -> Computation:
    """Revenue of discounted lines over a window of 21 months; no row without a line."""
    lines = Select(scan("lineitem"), where=lambda l: (l["l_shipdate"] >= day(start)) & (l["l_shipdate"] < day(end)) & (l["l_discount"] >= low) & (l["l_discount"] <= high) & (l["l_quantity"] < quantity))
    return Aggregate(lines, None, lambda l: {"revenue": exact_sum_of(l["l_extendedprice"] * l["l_discount"])})


def q12(start: str = "1997-01-01", end: str = "1998-01-01", modes: tuple[str, ...] = ("A", "R")) -> Computation:
    """High and low priority lines by mode; the return flag stands for the ship mode."""
    lines = Select(scan("lineitem"), where=lambda l: l["l_returnflag"].isin(*modes) & (l["l_shipdate"] >= day(start)) & (l["l_shipdate"] < day(end)))
    joined = Join(scan("orders"), lines, where=lambda o, l: o["o_orderkey"] == l["l_orderkey"], fields=lambda o, l: {"mode": l["l_returnflag"], "high": o["o_orderpriority"].isin("1-URGENT", "2-HIGH")})

    def count_if(flag) -> Fold:
        return fold(flag, lambda c: F.sum(F.when(c, 1).otherwise(0)), "count_if")

    return Aggregate(joined, lambda j: {"mode": j["mode"]}, lambda j: {"high_line_count": count_if(j["high"]), "low_line_count": count_if(~j["high"])})


def q13(prefix: str = "1") -> Computation:
    """How many customers have how many orders of a kind; customers without one don't appear. A prefix of the priority stands for the comment search."""
    orders = Select(scan("orders"), where=lambda o: o["o_orderpriority"].apply(lambda c: F.startswith(c, F.lit(prefix))))
    joined = Join(scan("customer"), orders, where=lambda c, o: c["c_custkey"] == o["o_custkey"], fields=lambda c, o: {"c_custkey": c["c_custkey"]})
    per_customer = Aggregate(joined, lambda j: {"c_custkey": j["c_custkey"]}, lambda j: {"c_count": count_of()})
    return Aggregate(per_customer, lambda a: {"c_count": a["c_count"]}, lambda a: {"custdist": count_of()})


def q14(start: str = "1997-09-01", end: str = "1997-10-01") -> Computation:
    """Share of promotion revenue."""
    lines = Select(scan("lineitem"), where=lambda l: (l["l_shipdate"] >= day(start)) & (l["l_shipdate"] < day(end)))
    joined = Join(
        lines, scan("part"), where=lambda l, p: l["l_partkey"] == p["p_partkey"], fields=lambda l, p: {"price": l["l_extendedprice"] * (1 - l["l_discount"]), "promo": p["p_type"].apply(lambda t: F.startswith(t, F.lit("PROMO")))}
    )
    sums = Aggregate(joined, None, lambda j: {"promo": exact_sum_of(native(lambda f, x: F.when(f, x).otherwise(0.0), j["promo"], j["price"])), "whole": exact_sum_of(j["price"])})
    return Select(sums, fields=lambda s: {"promo_revenue": s["promo"] * 100.0 / s["whole"]})


def q17(brand: str = "Brand#23") -> Computation:
    """Revenue of lines below a fifth of their part's mean quantity; not divided by seven. Without a container only the brand selects."""
    part = Select(scan("part"), where=lambda p: p["p_brand"] == brand)
    lines = Join(scan("lineitem"), part, where=lambda l, p: l["l_partkey"] == p["p_partkey"], fields=lambda l, p: {"l_partkey": l["l_partkey"], "l_quantity": l["l_quantity"], "l_extendedprice": l["l_extendedprice"]})
    means = Aggregate(lines, lambda l: {"mean_part": l["l_partkey"]}, lambda l: {"mean": exact_avg_of(l["l_quantity"])})
    small = Join(lines, means, where=lambda l, m: (l["l_partkey"] == m["mean_part"]) & (l["l_quantity"] < 0.2 * m["mean"]), fields=lambda l, m: {"l_extendedprice": l["l_extendedprice"]})
    return Aggregate(small, None, lambda s: {"total": exact_sum_of(s["l_extendedprice"])})


def q22(codes: tuple[int, ...] = (3, 7, 11, 13, 17, 19, 23), orders: int = 1) -> Computation:
    """Customers with exactly one order (or another number) and a balance above the mean of the codes' positive balances, by code; the nation stands for the phone's code."""
    mean = Aggregate(
        Select(scan("customer"), where=lambda c: c["c_nationkey"].isin(*codes) & (c["c_acctbal"] > 0.0)),
        None,
        lambda c: {"mean_balance": exact_avg_of(c["c_acctbal"])},
    )
    counts = Aggregate(scan("orders"), lambda o: {"o_custkey": o["o_custkey"]}, lambda o: {"n": count_of()})
    single = Select(counts, where=lambda a: a["n"] == orders)
    joined = Join(
        scan("customer"),
        single,
        mean,
        where=lambda c, o, m: (c["c_custkey"] == o["o_custkey"]) & (c["c_acctbal"] > m["mean_balance"]),
        fields=lambda c, o, m: {"code": c["c_nationkey"], "c_acctbal": c["c_acctbal"]},
        hints={2: "broadcast"},  # one row
    )
    return Aggregate(joined, lambda j: {"code": j["code"]}, lambda j: {"numcust": count_of(), "totacctbal": exact_sum_of(j["c_acctbal"]), "avgacctbal": exact_avg_of(j["c_acctbal"])})


def q04_spec(start: str = "1997-07-01", end: str = "1997-10-01"):
    """The standard form: orders that have a line, each counted once (a semi join)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = store(spark, sf_dir)
        orders, lines = own.read(DB, "orders"), own.read(DB, "lineitem")
        held = orders.where((F.col("o_orderdate") >= day(start)) & (F.col("o_orderdate") < day(end)))
        return held.join(lines, held["o_orderkey"] == lines["l_orderkey"], "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))

    return run


def q13_spec(spark: SparkSession, sf_dir: str, prefix: str = "1") -> DataFrame:
    """The standard form: orders of the kind are excluded, and customers without orders count (an outer join)."""
    own = store(spark, sf_dir)
    orders = own.read(DB, "orders").where(~F.startswith("o_orderpriority", F.lit(prefix)))
    joined = own.read(DB, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count")).groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))


def q22_spec(spark: SparkSession, sf_dir: str, codes: tuple[int, ...] = (3, 7, 11, 13, 17, 19, 23), since: str = "2000-01-01") -> DataFrame:
    """The standard form: customers of the codes without an order (an anti join); of late, since here everybody has one."""
    own = store(spark, sf_dir)
    held = own.read(DB, "customer").where(F.col("c_nationkey").isin(*codes))
    mean = held.where("c_acctbal > 0").agg((F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double") / F.count("c_acctbal").cast("double")).alias("mean_balance"))
    rich = held.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean_balance"))  # one row
    lone = rich.join(own.read(DB, "orders").where(F.col("o_orderdate") >= F.lit(since).cast("timestamp")), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return lone.groupBy(F.col("c_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("numcust"), F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double").alias("totacctbal"))


def graph_query(make) -> object:
    return lambda spark, sf_dir: store(spark, sf_dir).frame(make())


def S(x: str, scale: int = 4) -> str:
    """An exact sum in the oracle."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def A(x: str) -> str:
    return f"{S(x)} / CAST(count({x}) AS DOUBLE)"


def D(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


QUERIES = {f"q{k:02d}": graph_query(f) for k, f in ((1, q01), (2, q02), (3, q03), (4, q04), (6, q06), (12, q12), (13, q13), (14, q14), (17, q17), (22, lambda: q22(orders=8)))}  # nobody has one order here
QUERIES |= {"q04_spec": q04_spec(), "q13_spec": q13_spec, "q22_spec": q22_spec}
_CODES = "(3, 7, 11, 13, 17, 19, 23)"
ORACLE = {
    "q01": f"""SELECT l_returnflag, l_linestatus, {S('l_quantity')} AS sum_qty, {S('l_extendedprice')} AS sum_base_price,
      {S('l_extendedprice * (1 - l_discount)')} AS sum_disc_price, {S('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 8)} AS sum_charge,
      {A('l_quantity')} AS avg_qty, {A('l_extendedprice')} AS avg_price, {A('l_discount')} AS avg_disc, count(*) AS count_order
      FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "q02": """WITH ps AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY 1, 2),
      o AS (SELECT p_partkey, p_brand, ps_supplycost, s_name, s_acctbal, n_name FROM ps JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size = 15 AND p_type LIKE '%SMALL' AND r_name = 'EUROPE')
      SELECT o.* FROM o JOIN (SELECT p_partkey, min(ps_supplycost) AS m FROM o GROUP BY 1) x ON o.p_partkey = x.p_partkey AND o.ps_supplycost = x.m""",
    "q03": f"""SELECT o_orderkey, {D('o_orderdate')} AS o_orderdate, o_orderpriority, {S('l_extendedprice * (1 - l_discount)')} AS revenue
      FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY 1, 2, 3""",
    "q04": f"""SELECT o_orderpriority, count(*) AS order_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      WHERE {D('o_orderdate')} >= '1997-07-01' AND {D('o_orderdate')} < '1997-10-01' GROUP BY 1""",
    "q06": f"""SELECT {S('l_extendedprice * l_discount')} AS revenue FROM lineitem
      WHERE {D('l_shipdate')} >= '1997-01-01' AND {D('l_shipdate')} < '1998-10-01' AND l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_quantity < 24 HAVING count(*) > 0""",
    "q12": f"""SELECT l_returnflag AS mode, CAST(count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS high_line_count,
      CAST(count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS low_line_count
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND {D('l_shipdate')} >= '1997-01-01' AND {D('l_shipdate')} < '1998-01-01' GROUP BY 1""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(*) AS c_count FROM customer JOIN orders ON c_custkey = o_custkey
      WHERE o_orderpriority LIKE '1%' GROUP BY 1) GROUP BY 1""",
    "q14": f"""SELECT {S("CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END")} * 100.0::DOUBLE / {S('l_extendedprice * (1 - l_discount)')} AS promo_revenue
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {D('l_shipdate')} >= '1997-09-01' AND {D('l_shipdate')} < '1997-10-01' HAVING count(*) > 0""",
    "q17": f"""WITH l AS (SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23'),
      m AS (SELECT l_partkey, {A('l_quantity')} AS mean FROM l GROUP BY 1)
      SELECT {S('l_extendedprice')} AS total FROM l JOIN m USING (l_partkey) WHERE l_quantity < 0.2::DOUBLE * mean HAVING count(*) > 0""",
    "q22": f"""WITH m AS (SELECT {A('c_acctbal')} AS mean FROM customer WHERE c_nationkey IN {_CODES} AND c_acctbal > 0),
      o AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 8)
      SELECT c_nationkey AS code, count(*) AS numcust, {S('c_acctbal')} AS totacctbal, {A('c_acctbal')} AS avgacctbal FROM customer JOIN o ON c_custkey = o_custkey, m WHERE c_acctbal > mean GROUP BY 1""",
    "q04_spec": f"""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE {D('o_orderdate')} >= '1997-07-01' AND {D('o_orderdate')} < '1997-10-01'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""",
    "q13_spec": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY 1) GROUP BY 1""",
    "q22_spec": f"""WITH m AS (SELECT {A('c_acctbal')} AS mean FROM customer WHERE c_nationkey IN {_CODES} AND c_acctbal > 0)
      SELECT c_nationkey AS code, count(*) AS numcust, {S('c_acctbal')} AS totacctbal FROM customer, m WHERE c_nationkey IN {_CODES} AND c_acctbal > mean
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1""",
}
__all__ = ["DB", "ORACLE", "QUERIES", "A", "D", "S", "avg_of", "graph_query", "scan", "store"]
