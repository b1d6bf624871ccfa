"""URL filters: longest-match rules, then link-graph propagation.

A rule decides the pages it fits.  The rest are judged by their host:
trust spreads by personalised PageRank along host links from the hosts
of allowed pages, distrust along reversed links from the hosts of
blocked pages (who links to the blocked is suspect).  Both scores are
divided by the host's share of all pages, so 1 is what an even spread
would give; a host is blocked when its distrust exceeds ``tau`` and its
trust.

Links are counted per (host, host) before anything is joined, so a hot
host is a row, and ranks live in Spark tables written to the shared
folder between rounds.  Rounds go on until the mass still to move can
change no host's score by more than ``TOLERANCE`` (a round keeps at most
``DAMPING`` of the moved mass, so they end).  Mass that reaches a host without links is not
returned; that scales all scores alike and the final shares undo it.

Defined cases: a null url, or one without ``://``, has an empty host
and path, fits no rule and is allowed unless the empty host is blocked;
a null html has no links; links of a host to itself don't count; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.common import drop_stage, lookup_join, materialize, table, write_stage

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the contract.  Fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING, BLOCK, TAU = 0.85, 3, 1.0
#: Of a score, where 1 is an even share.
TOLERANCE = 1e-6
#: Rounds of the DuckDB twin, which can't iterate to a tolerance: it says
#: less than the query where mass moves along more links than that.
ROUNDS = 12
LINK = "(?i)href[\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*[\"']?(?:https?:)?//([^/?#\"'<>\\x20\\x09-\\x0D]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    host = F.translate(raw, _UP, _LOW)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, path).otherwise("")


def by_rules(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, p): the share of src's links that go to dst, other hosts only."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", _UP, _LOW).alias("dst")).where("src <> dst and src <> ''")
    found = found.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return _shares(found.withColumnRenamed("n", "p"))


def _shares(edges: DataFrame) -> DataFrame:
    """The weights ``p`` divided by their sum per src."""
    out = edges.groupBy("src").agg(F.sum("p").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("p") / F.col("total")).alias("p"))


def propagate(seeds: DataFrame, links: DataFrame, pages: int, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank of ``seeds`` (host, seed) along
    ``links`` (src, dst, p), converged for shares of ``pages`` pages.

    ``step`` is what the last round added; all that later ones can add is
    DAMPING / (1 - DAMPING) of it."""
    spark = seeds.sparkSession
    base = seeds.select("host", ((1 - DAMPING) * F.col("seed")).cast("double").alias("rank"))
    state = base.select("*", F.col("rank").alias("step"))
    least = base.agg(F.sum("rank")).first()[0]
    path = None
    while True:
        for _ in range(BLOCK):
            moved = links.join(state, links["src"] == state["host"]).select(F.col("dst").alias("host"), *[(DAMPING * F.col("p") * F.col(c)).alias(c) for c in ("rank", "step")])
            state = moved.unionByName(base.select("*", F.lit(0.0).alias("step"))).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("step").alias("step"))
        schema, last, path = state.schema, path, write_stage(state, "ranks")
        state = spark.read.schema(schema).parquet(path)
        if last:
            drop_stage(spark, last)
        step = state.agg(F.sum("step")).first()[0]
        if not step or step * DAMPING / (1 - DAMPING) * pages <= tolerance * least:
            return state.select("host", "rank")


def judge_hosts(pages: DataFrame, links: DataFrame, tau: float = TAU) -> DataFrame:
    """The blocked hosts of ``pages`` (host, verdict by rule or null)."""
    count = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0))
    hosts = materialize(pages.groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("good"), count("block").alias("bad")), "hosts")
    score = hosts.select("host", "n")
    pages_in_all = hosts.agg(F.sum("n")).first()[0] or 0
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")
    for name, seed, edges in (("trust", "good", links), ("distrust", "bad", materialize(_shares(back), "back"))):
        ranks = propagate(hosts.where(F.col(seed) > 0).select("host", F.col(seed).cast("double").alias("seed")), edges, pages_in_all)
        score = score.join(ranks.withColumnRenamed("rank", name), "host", "left")
    score = score.select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    total = score.select(F.sum("n").alias("n"), F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    if not total["n"] or not total["d"]:
        return score.where("false").select("host", F.lit("block").alias("host_verdict"))
    part = lambda c, t: F.col(c) / float(t or 1.0) * float(total["n"]) / F.col("n")
    bad = part("distrust", total["d"])
    return score.where((bad > tau) & (bad > part("trust", total["t"]))).select("host", F.lit("block").alias("host_verdict"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = by_rules(rules)
    d = d.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))
    links = materialize(host_links(d), "links")
    blocked = materialize(judge_hosts(d.select("host", "rule_verdict"), links), "blocked")
    d = lookup_join(d.drop("html"), blocked, ["host"], F.col("page_id"))
    return d.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _oracle() -> str:
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{f(v, h, p)}'" for v, h, p in rules) + " END"
    low = lambda c: f"translate({c}, '{_UP}', '{_LOW}')"
    steps = []
    for x, seed, links in (("t", "good", "fwd"), ("d", "bad", "bwd")):
        steps.append(f"{x}0 AS (SELECT host, {1 - DAMPING!r}::DOUBLE * {seed} AS rank FROM hosts WHERE {seed} > 0)")
        for i in range(ROUNDS):
            steps.append(f"{x}{i + 1} AS (SELECT host, sum(rank) AS rank FROM (SELECT dst AS host, {DAMPING}::DOUBLE * p * rank AS rank "
                         f"FROM {links} JOIN {x}{i} ON src = host UNION ALL SELECT host, rank FROM {x}0) GROUP BY host)")
    n = ROUNDS
    return f"""
WITH u AS (SELECT page_id, html, instr(coalesce(url, ''), '://') AS pos, substr(url, instr(url, '://') + 3) AS rest FROM pages),
h AS (SELECT page_id, html, CASE WHEN pos > 0 THEN {low("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
  CASE WHEN pos > 0 THEN regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') ELSE '' END AS path FROM u),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS rv FROM h),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS good, count(*) FILTER (rv = 'block') AS bad FROM r GROUP BY host),
e AS (SELECT host AS src, {low('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)) AS dst FROM r)),
c AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst AND src <> '' GROUP BY ALL),
fwd AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c),
bwd AS (SELECT dst AS src, src AS dst, p / sum(p) OVER (PARTITION BY dst) AS p FROM fwd),
{", ".join(steps)},
s AS (SELECT host, n, coalesce(t.rank, 0) AS t, coalesce(d.rank, 0) AS d FROM hosts LEFT JOIN t{n} t USING (host) LEFT JOIN d{n} d USING (host)),
w AS (SELECT host, d / nullif(sum(d) OVER (), 0) * sum(n) OVER () / n AS bad, t / coalesce(nullif(sum(t) OVER (), 0), 1) * sum(n) OVER () / n AS good FROM s)
SELECT page_id, r.host AS host, path, rule,
       coalesce(rv, CASE WHEN bad > {TAU} AND bad > good THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN w USING (host)
"""


ORACLE_SQL = _oracle()
