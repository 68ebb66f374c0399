"""URL filters: rules first, and for the other urls trust and distrust that spread over links between hosts.

Method (DataFrame functions only). Links in html become edges between hosts, summed over pages before they meet; a host's
links to itself carry nothing. A host is a trusted seed if rules allow over half of its pages, and a blocked seed if they
block over half. Trust is personalised PageRank from the trusted seeds along the edges; distrust is the same from the
blocked seeds against the edges: a host that links to blocked hosts takes distrust. A host is blocked where its distrust
is above its trust by more than rounding (a share of TIE). What reaches a host without links ahead ends there. Every round joins the edges with what the last one moved and sums by host; rounds go on until no new
host is reached and what is still to move is below TOLERANCE of all mass.

A rule `host/path` fits its host and all subdomains if the url's path starts with /path; the longest that fits decides.
Rules are a list in the program, so they are tested in one expression.

Defined cases: a null url or one without `://`: empty host and path, no rule, allow; null and empty html has no links; html of any length
is read whole; repeated pages count as often as they occur; hosts without any score, and those of equal trust and distrust: allow; an empty table gives an empty result; input columns named
like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.llm import common as C

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DAMPING = 0.85
#: Rounds of the SQL form, which can't stop by itself.
ROUNDS = 10
#: Mass that may be left to move when rounds end.
TOLERANCE = 1e-9
#: Scores are sums in any order; so much of the trust is no difference.
TIE = 1e-9
OUT = ("host", "path", "rule", "verdict")
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts; pages: (host, html)."""
    links = pages.where("host != ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    named = links.select(F.col("host").alias("src"), F.translate("link", UPPER, LOWER).alias("dst")).where("src != dst AND dst != ''")
    return named.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, mass; the masses sum to 1) over edges (src, dst, share); without a number of rounds until it has converged."""
    base = seeds.select("host", ((1 - damping) * F.col("mass")).alias("score"))
    now = base
    if rounds is not None:
        for _ in range(rounds):
            moved = edges.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            now = C.materialise(base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")))
        return now
    # `step` is what a walk of one more link brings; score is the sum of all steps
    now = C.materialise(base.select("host", "score", F.col("score").alias("step")))
    reached = now.count()
    while True:
        moved = edges.join(now.where("step > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("host"), F.lit(0.0).alias("score"), (damping * F.col("step") * F.col("share")).alias("step"))
        kept = now.select("host", "score", F.lit(0.0).alias("step"))
        summed = kept.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"), F.sum("step").alias("step"))
        before, now = now, C.materialise(summed.select("host", (F.col("score") + F.col("step")).alias("score"), "step"))
        C.discard(before)
        n, change = now.agg(F.count(F.lit(1)), F.coalesce(F.sum("step"), F.lit(0.0))).first()
        # later steps add up to at most change * damping / (1 - damping)
        if n == reached and change * damping <= tolerance * (1 - damping):
            return now.select("host", "score")
        reached = n


def host_verdicts(pages: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, host_verdict) of the hosts that are blocked; pages: (host, html, ruled)."""
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    counts = C.materialise(counts.where("host != ''"))
    edges = C.materialise(host_edges(pages))
    linked = edges.limit(1).count() > 0

    def seeds(which: str) -> DataFrame:
        own = counts.where(2 * F.col(which) > F.col("n"))
        return own.select("host", F.lit(1.0 / max(1, own.count())).alias("mass"))

    def shares(src: str, dst: str) -> DataFrame:
        out = edges.groupBy(F.col(src).alias("src")).agg(F.sum("w").alias("total"))
        return C.materialise(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "w").join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))

    trust = spread(seeds("good"), shares("src", "dst") if linked else None, damping, rounds if linked else 0)
    distrust = spread(seeds("bad"), shares("dst", "src") if linked else None, damping, rounds if linked else 0)
    both = distrust.withColumnRenamed("score", "distrust").join(trust.withColumnRenamed("score", "trust"), "host", "left")
    return C.materialise(both.where(F.col("distrust") > F.coalesce("trust", F.lit(0.0)) * (1 + TIE)).select(F.col("host").alias("__sf_host"), F.lit("block").alias("host_verdict")))


def judge(df: DataFrame, url: str = "url", html: str = "html", rules=RULES, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """df with host, path, rule and verdict."""
    address = F.col(f"`{url}`")
    named = C.without(df, *OUT).withColumns({"host": host_of(address), "path": path_of(address)})
    ruled = named.withColumn("__sf_rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = host_verdicts(ruled.select("host", F.col(f"`{html}`").alias("html"), F.col("__sf_rule.verdict").alias("ruled")), damping, rounds)
    joined = ruled.join(blocked, F.col("host") == F.col("__sf_host"), "left")
    return joined.withColumns({"rule": F.col("__sf_rule.rule"), "verdict": F.coalesce("__sf_rule.verdict", "host_verdict", F.lit("allow"))}).drop("__sf_rule", "__sf_host", "host_verdict")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = []
    for text, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        own, _, start = text.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')", text, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = LINK.replace("'", "''")
    parts = [
        r"named AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), "
        f"'{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path "
        "FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages))",
        f"ruled AS (SELECT *, {case(1)} AS rule, {case(2)} AS rv FROM named)",
        "counts AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS good, count(*) FILTER (rv = 'block') AS bad FROM ruled WHERE host != '' GROUP BY host)",
        f"links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM ruled WHERE host != '')",
        "edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM links WHERE src != dst AND dst != '' GROUP BY src, dst)",
    ]
    for name, which, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts += [
            f"{name}s AS (SELECT host, {1 - DAMPING}::DOUBLE / (count(*) OVER ()) AS score FROM counts WHERE 2 * {which} > n)",
            f"{name}e AS (SELECT {src} AS src, {dst} AS dst, w / sum(w) OVER (PARTITION BY {src}) AS share FROM edges)",
            f"{name}0 AS (SELECT * FROM {name}s)",
        ]
        for k in range(1, ROUNDS + 1):
            parts.append(
                f"{name}{k} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}s UNION ALL "
                f"SELECT dst AS host, {DAMPING}::DOUBLE * score * share AS score FROM {name}e JOIN {name}{k - 1} ON src = host) GROUP BY host)"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, r.host, path, rule, coalesce(rv, CASE WHEN d.score > coalesce(t.score, 0) * (1 + {TIE}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM ruled r LEFT JOIN d{ROUNDS} d ON r.host = d.host LEFT JOIN t{ROUNDS} t ON r.host = t.host"
    )


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE = {"op4_url_filter": _oracle()}
