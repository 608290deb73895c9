"""URL filter: listed rules first, then trust and distrust spread over host edges.

Pages under allow rules are trusted seeds, pages under block rules are blocked seeds.
Personalised PageRank carries trust along host edges and distrust against them (a page
that links to a blocked host becomes suspect). A host is blocked when the distrust that
has come over at least one link outweighs its trust by ``ratio`` and by a small part of
what a blocked seed gets.

A rule that names a path below ``/`` judges that part of a host only. Its pages are a node
of their own (``example.com/de/``) beside the host's, so the rest of the host neither
starts with their mass nor is blocked for it. A blocked host needs no page in the table:
it is a seed if a page links to it.

Edges are the absolute links in the page bodies, and ties between a host and its site,
the name registered below a public suffix (``a.b.example.com`` and ``example.com``,
but ``a.co.uk`` and ``co.uk`` share nothing). Ties carry less weight, and mass that has
come by ties alone never blocks; it is told apart in ``tied``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import write_table

# Fixed values: (verdict, host, path) as listed.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Everything after an absolute link's "//" up to a query, fragment or quote, in href, src or action.
LINK = "(?i)(?:href|src|action)\\s*=\\s*[\"']?(?:https?:)?//([^\"'\\s>/?#][^\"'\\s>?#]*)"
# Second-level names under which country registries sell (co.uk, com.au), and
# domains whose owners hand out names to others.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
PRIVATE_SUFFIXES = (
    "appspot.com", "blogspot.com", "cloudfront.net", "fly.dev", "github.io", "gitlab.io", "herokuapp.com", "netlify.app",
    "pages.dev", "readthedocs.io", "s3.amazonaws.com", "vercel.app", "web.app", "wordpress.com", "workers.dev",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame) -> DataFrame:
    """Add ``rule`` (longest fitting, like ``net/``) and ``ruled`` (its verdict); null where none fits."""
    out = pages.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = out.withColumn("rule", F.when(fits, F.lit(host + path)).otherwise(F.col("rule")))
        out = out.withColumn("ruled", F.when(fits, F.lit(verdict)).otherwise(F.col("ruled")))
    return out


def site_of(host: Column) -> Column:
    """The name registered below a public suffix; null where the host is itself one, an address or empty.

    Public suffixes: ``PRIVATE_SUFFIXES``, a country code (two letters) below one of
    ``REGISTRY_LABELS``, else the last label.
    """
    private = "|".join(s.replace(".", "\\.") for s in PRIVATE_SUFFIXES)
    suffix = f"(?:{private}|(?:{'|'.join(REGISTRY_LABELS)})\\.[a-z]{{2}}|[^.0-9][^.]*)"
    bare = host.rlike(f"^{suffix}$")
    return F.when(~bare, F.nullif(F.regexp_extract(host, f"([^.]+\\.{suffix})$", 1), F.lit("")))


def with_node(pages: DataFrame) -> DataFrame:
    """Add ``rule``, ``ruled`` and ``node``: the host, or host and path of a rule that names a path below ``/``."""
    out = with_rule(pages)
    part = F.substring_index("rule", "/", 1)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    return out.withColumn("node", F.when(part.isNotNull() & (path != "/"), F.concat("host", path)).otherwise(F.col("host")))


def links_of(pages: DataFrame, node: str = "host") -> DataFrame:
    """``src, host, path, weight``: each absolute link target once a page, added up over the pages of a node."""
    host = F.translate(F.substring_index("to", "/", 1), UPPER, LOWER)
    return (
        pages.where(F.col("html").rlike(LINK))
        .select(F.col(node).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
        .groupBy("src", host.alias("host"), F.expr("substring(to, length(substring_index(to, '/', 1)) + 1)").alias("path"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def host_edges(pages: DataFrame, site_weight: float, links: DataFrame | None = None) -> DataFrame:
    """``src, dst, weight, tie`` over nodes, without loops: links in bodies (those given, else of the pages) plus ties of hosts to their site."""
    links = (with_node(links_of(pages)) if links is None else links).groupBy("src", F.col("node").alias("dst")).agg(F.sum("weight").alias("weight")).withColumn("tie", F.lit(False))
    own = pages.select("host", site_of(F.col("host")).alias("site")).distinct().where(F.col("site") != F.col("host"))
    w, tie = F.lit(float(site_weight)).alias("weight"), F.lit(True).alias("tie")
    ties = own.select(F.col("host").alias("src"), F.col("site").alias("dst"), w, tie).union(own.select(F.col("site"), F.col("host"), w, tie))
    return links.union(ties).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "") & (F.col("weight") > 0))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float, tol: float = 1e-3) -> DataFrame:
    """Personalised PageRank of both kinds at once: ``host, trust, distrust, linked``.

    ``edges``: src, dst, weight, and optionally tie (else all are links). ``seeds``: host,
    trust, distrust (each sums to one, or is zero everywhere). Trust follows edges, distrust
    runs against them. ``linked`` is the part of ``distrust`` that has come over a link
    at some step: the walk's state tells whether it has used one yet. Each round is one
    join on the sending host and one sum on the receiving host; the sum combines before it
    shuffles, and the join's edge side is splittable. Without ``rounds``, rounds go on
    until four of them move less than ``tol`` of either kind's mass; what is still to
    move is then of that size.
    """
    if "tie" not in edges.columns:
        edges = edges.withColumn("tie", F.lit(False))
    both = edges.select(F.lit(0).alias("kind"), F.col("src").alias("frm"), F.col("dst").alias("to"), "weight", "tie").union(
        edges.select(F.lit(1), F.col("dst"), F.col("src"), "weight", "tie")
    )
    total = both.groupBy("kind", "frm").agg(F.sum("weight").alias("total"))
    steps = write_table(
        both.join(total, ["kind", "frm"]).groupBy("kind", "frm", "to", "tie").agg((F.sum("weight") / F.first("total") * damping).alias("p")), "host-steps"
    )
    start = write_table(
        seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("mass")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("mass")))).alias("s"), "host")
        .select("s.kind", "host", F.lit(False).alias("linked"), "s.mass")
        .where(F.col("mass") > 0),
        "host-seeds",
    )
    base = start.withColumn("mass", F.col("mass") * (1 - damping))
    now = last = start
    state = ["kind", "host", "linked"]
    for k in itertools.count() if rounds is None else range(rounds):
        moved = now.withColumnRenamed("host", "frm").join(steps, ["kind", "frm"])
        moved = moved.select("kind", F.col("to").alias("host"), (F.col("linked") | ~F.col("tie")).alias("linked"), (F.col("mass") * F.col("p")).alias("mass"))
        now = moved.union(base.select(*state, "mass")).groupBy(*state).agg(F.sum("mass").alias("mass"))
        if rounds is not None and k % 2:
            now = write_table(now, "host-mass")
        if rounds is None and k % 4 == 3:
            now = write_table(now, "host-mass")
            change = now.union(last.select(*state, -F.col("mass"))).groupBy(*state).agg(F.sum("mass").alias("mass"))
            if all(r[1] < tol for r in change.groupBy("kind").agg(F.sum(F.abs("mass"))).collect()):  # two rows
                break
            last = now
    side = lambda cond: F.sum(F.when(cond, F.col("mass")).otherwise(0.0))
    kind = F.col("kind")
    return now.groupBy("host").agg(side(kind == 0).alias("trust"), side(kind == 1).alias("distrust"), side((kind == 1) & F.col("linked")).alias("linked"))


def judge_urls(pages: DataFrame, rounds: int | None = None, damping: float = 0.85, ratio: float = 1.0, level: float = 2.0, site_weight: float = 0.1) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, trust, distrust, tied``.

    ``verdict`` is the fitting rule's; without one, a page is blocked when the distrust
    that reached its host over links is over ``ratio`` times the host's trust plus ``level``
    hundredths of the mean share that a blocked seed gets from its own start, else allowed:
    neither the number of hosts nor that of seeds decides. ``distrust`` is that part,
    ``tied`` what came by ties to the site alone. A null url or one without ``://`` has
    empty host and path, and is allowed. Null html has no links. Repeated rows are judged
    alike, one row each; other columns are ignored; an empty table gives an empty result.
    """
    parsed = with_node(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    )
    links = write_table(with_node(links_of(parsed, "node").where(F.col("src") != "")), "links")  # bodies are searched once
    named = links.select("node", "ruled", F.col("weight").alias("n"))
    nodes = write_table(
        parsed.where(F.col("host") != "").select("node", "ruled", F.lit(1.0).alias("n")).union(named)
        .groupBy("node")
        .agg(*[F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0.0)).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked"))]),
        "hosts",
    ).where(F.col("node") != "")
    sums = nodes.agg(F.sum("allowed"), F.sum("blocked"), F.count_if(F.col("blocked") > 0)).first()  # one row
    seeds = nodes.select(
        F.col("node").alias("host"), (F.col("allowed") / F.lit(sums[0] or 1.0)).alias("trust"), (F.col("blocked") / F.lit(sums[1] or 1.0)).alias("distrust")
    )
    scores = write_table(spread(write_table(host_edges(parsed, site_weight, links), "host-edges"), seeds, rounds, damping), "host-scores")
    judged = parsed.drop("html").join(scores.withColumnRenamed("host", "node"), "node", "left")
    least = level / 100 * (1 - damping) / max(1, sums[2])
    bad = F.col("linked") > F.lit(ratio) * F.col("trust") + F.lit(least)
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score(F.col("trust")).alias("trust"),
        score(F.col("linked")).alias("distrust"),
        score(F.col("distrust") - F.col("linked")).alias("tied"),
    )
