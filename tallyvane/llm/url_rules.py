"""URL filters: rules by host and path, and decisions carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, components, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CANONICAL = r"""(?i)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL without its fragment: what a server is asked for."""
    return F.substring_index(url, "#", 1)


def resolved(target: Column, base: Column) -> Column:
    """Absolute form of a link: as it is, with the scheme or host of ``base``, or in its folder."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]*://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target)).otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), target))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links (a, b) from a page to its canonical URL and to where it redirects."""
    html, url = F.coalesce(col(html_col).cast("string"), F.lit("")), col(url_col).cast("string")
    found = lambda tag, attribute: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))
    out = pages.filter(url.contains("://")).select(url.alias("u"), F.explode(F.concat(found(CANONICAL, HREF), found(REFRESH, TARGET))).alias("t")).filter("t <> ''")
    return out.select(node_of(F.col("u")).alias("a"), node_of(resolved(F.col("t"), F.col("u"))).alias("b")).filter("a <> b").distinct()


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host and path, or nulls.

    A rule's length is that of its host and path together; of equally long ones the first listed
    wins. It fits its host and all subdomains.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in ordered])
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def judge(
    pages: DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
    rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow",
) -> DataFrame:
    """Operator 4. Per page: id, host, path, rule, verdict.

    URLs are equivalent when redirects or canonical links join them, over any number of steps. A
    page with a rule takes the rule's verdict. Another takes that of its equivalents: allowed if
    one of them is allowed by a rule, else blocked if one is blocked by a rule, else ``default``.
    Link ends are judged whether or not they are pages of the table. ``links`` (a, b) adds
    redirects that were recorded elsewhere.

    Components are found by distributed stars over the links alone; pages are joined with the
    verdicts of linked URLs as a plain exchange, so a host or URL that owns a third of all pages
    is split by Spark.

    Defined cases: a null URL, or one without ``://``, has empty host and path, no rule and no
    equivalents; null or empty pages have no links; repeated rows and ids are each judged; an
    empty table gives an empty result; columns other than those named are not read.
    """
    url = col(url_col).cast("string")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select(col(id_col).alias("page_id"), url.alias("u"), host_of(url).alias("host"), path_of(url).alias("path")).select("*", name.alias("rule"), verdict.alias("own"))
    found = [] if html_col is None else [alias_links(pages, url_col, html_col)]
    if links is not None:
        found.append(links.select(node_of(col("a").cast("string")).alias("a"), node_of(col("b").cast("string")).alias("b")))
    if not found:
        return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))
    edges = table(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "aliases")
    member = components(edges)
    ends = member.select("id", "comp", host_of(F.col("id")).alias("host"), path_of(F.col("id")).alias("path"))
    decided = ends.select("comp", rule_for(F.col("host"), F.col("path"), rules)[1].alias("own")).groupBy("comp").agg(
        F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0)).alias("d")
    )
    carried = F.when(F.col("d") == 2, "allow").when(F.col("d") == 1, "block")
    shared = table(member.join(decided.filter("d > 0"), "comp").select(F.col("id").alias("node"), carried.alias("carried")), "carried")
    both = judged.withColumn("node", F.when(F.col("u").contains("://"), node_of(F.col("u")))).join(shared, "node", "left")
    return both.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("own", "carried", F.lit(default)).alias("verdict"))
