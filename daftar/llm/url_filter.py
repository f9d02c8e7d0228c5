"""URL rules, and block decisions carried to aliases by redirect equivalence.

A rule is ``host/path-prefix``; it fits its host and all subdomains, and the
longest fitting rule decides.  Pages that no rule decides take the decision of
their alias class: URLs linked by redirects (meta refresh, or a table of
redirects) and canonical links, as connected components.  In a class an explicit
allow goes before every block; without either the page is allowed.

The rules are a parameter of the query, a few literals in the plan.  Only pages that
no rule decides and that touch an alias edge take part in the joins; HTML is
never shuffled.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits
no rule and is allowed; null or empty HTML gives no edge; repeated rows are judged
each for itself; very long URLs and HTML are searched whole; rules of equal length can't both fit
but by equal texts; a page with several canonical links or refreshes is an alias of each; a table without edges needs no join, an empty one gives an empty one.  Extra
columns of any name are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.components import connected_components
from daftar.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("org", "/", True),
    UrlRule("example.org", "/es/", False),
    UrlRule("example.org", "/en/1", False),
    UrlRule("com", "/fr/", True),
    UrlRule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The text of the longest rule that fits, else null."""
    found = F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        found = found.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
    return found


def verdict_of(rule: Column, rules: tuple[UrlRule, ...]) -> Column:
    """allow, block, or null where there is no rule."""
    allowed = [r.text for r in rules if r.allow]
    return F.when(rule.isin(allowed), "allow").when(rule.isNotNull(), "block")


def identity(url: Column) -> Column:
    """What makes two URLs the same: scheme and host lowered, no fragment."""
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(
            F.translate(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0), _UPPER, _LOWER),
            F.regexp_extract(url, r"(?s)^[^?#]*?://[^/?#]*([^#]*)", 1),
        ),
    )


def _target(base: Column, href: Column) -> Column:
    """A link's URL seen from a page's URL."""
    href = F.regexp_replace(href, "&amp;", "&")
    scheme = F.regexp_extract(base, r"^([^?#]*?:)//", 1)
    origin = F.regexp_extract(base, r"^[^?#]*?://[^/?#]*", 0)
    folder = F.concat(origin, F.regexp_replace(F.concat(path_of(base), F.when(path_of(base) == "", "/").otherwise("")), r"[^/]*$", ""))
    return (
        F.when((href == "") | href.startswith("#"), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("?"), F.concat(origin, path_of(base), href))
        .otherwise(F.concat(folder, href))
    )


def _without_dots(url: Column) -> Column:
    """A URL whose path has no ``.`` and ``..`` steps."""
    origin = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0)
    steps = F.split(F.substring(path_of(url), F.lit(2), F.length(url)), "/")
    last = F.element_at(steps, -1).isin(".", "..")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.array_append(done, step))

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    path = F.concat(F.lit("/"), F.array_join(F.when(last, F.array_append(walked, F.lit(""))).otherwise(walked), "/"))
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    return F.when(path_of(url).rlike(r"/\.\.?(/|$)"), F.concat(origin, path, tail)).otherwise(url)


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)``: all canonical links and meta refreshes of pages, between URL identities."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    links = every(r"""(?is)<link\b[^>]*\brel\s*=\s*(?:canonical\b|"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*')[^>]*>""")
    canonical = F.transform(links, lambda x: F.regexp_extract(x, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    metas = every(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""")
    refresh = F.transform(metas, lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return (
        pages.where(F.instr(url, "://") > 0)
        .select(url.alias("base"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("href"))
        .select(identity(F.col("base")).alias("src"), _target(F.col("base"), F.col("href")).alias("to"))
        .select("src", identity(_without_dots(F.col("to"))).alias("dst"))
        .where("dst is not null and src != dst")
    )


def judge(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every page.

    ``redirects`` may give further edges as URLs (src, dst).
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("h"), path_of(url).alias("p"), identity(url).alias("key"))
    own = own.select("id", "key", F.coalesce("h", F.lit("")).alias("host"), F.coalesce("p", F.lit("")).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = own.withColumn("verdict", verdict_of(F.col("rule"), rules))

    def done(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))

    edges = html_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(identity(F.col("src")).alias("src"), identity(F.col("dst")).alias("dst")))
    scratch = Scratch(pages.sparkSession, "aliases")
    edges = scratch.write(edges.distinct())
    if edges.isEmpty():
        return done(own)
    classes = connected_components(edges)
    node = F.col("node")
    decided = verdict_of(rule_of(host_of(node), path_of(node), rules), rules)
    by_class = (
        classes.withColumn("v", decided)
        .groupBy("component")
        .agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
        .where("blocked and not allowed")
    )
    blocked = classes.join(by_class, "component", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("carried"))
    open_ = own.where("verdict is null and key is not null").join(blocked, "key", "left").withColumn("verdict", F.col("carried"))
    rest = own.where("verdict is not null or key is null")
    return done(rest.unionByName(open_.drop("carried")))
