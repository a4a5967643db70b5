"""URL filters whose decisions follow redirects and canonical links.

Rules name a host with its subdomains and a path prefix; the longest rule that fits a
url decides. Urls that no rule fits get the decision of their aliases: the connected
components over redirect and canonical-link edges. In a component an explicit allow
takes precedence over a block.

Null urls, and those without ``://``, have an empty host and path and no aliases.
Repeated rows are rows of their own. Columns of the pages keep their values; of clashing
names, the result's is kept. Empty pages or rules give an empty result or no rule.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import connected_components
from auditloom.llm.shared import lower_ascii, stored

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ATTRIBUTE = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def node_of(url: Column) -> Column:
    """The url as a node: host, path and query; scheme and fragment make no difference."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE % name
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def links_of(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects, as they stand in the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<link") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")),
        lambda t: _attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1),
    )
    return F.filter(F.transform(F.concat(canonical, refresh), lambda u: F.trim(u)), lambda u: u != "")


def absolute(link: Column, url: Column) -> Column:
    """A link of a page as a whole url; null for what leads to no url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"(?is)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .when(~link.rlike(r"(?i)^(#|[a-z][a-z0-9+.-]*:)"), F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the canonical links and redirects in pages (url, html)."""
    # Most pages have neither; only the others are searched by regex.
    html = F.when(F.col("html").rlike("(?i)canonical|refresh"), F.col("html"))
    links = pages.select("url", F.explode(links_of(html)).alias("link"))
    return links.select(F.col("url").alias("from_url"), absolute(F.col("link"), F.col("url")).alias("to_url"))


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule, verdict) of the urls (key, host, path) that a rule (host, path, verdict) fits.

    A url meets the rules of its host and of each parent domain in an equi-join; the
    longest rule wins, and an allow wins over a block by the same rule.
    """
    labels = F.split("host", r"\.")
    count = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    each = urls.where("host <> ''").select("key", "path", F.explode(parents).alias("rule_host"))
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    fitting = each.join(named, "rule_host").where(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("length"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"))
    best = fitting.groupBy("key").agg(F.max(rank).alias("best"))
    return best.select(
        "key", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict")
    )


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, verdict) of the nodes of edges (from_url, to_url) whose component a rule fits."""
    linked = edges.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    members = stored(connected_components(linked), "aliases")
    urls = members.select(
        F.col("id").alias("key"),
        F.regexp_extract("id", "(?s)^([^/]*)", 1).alias("host"),
        F.regexp_extract("id", r"(?s)^[^/]*([^?]*)", 1).alias("path"),
    )
    told = rule_verdicts(urls, rules).withColumnRenamed("key", "id").drop("rule")
    by_component = members.join(told, "id").groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allowed")
    )
    return members.join(by_component, "component").select(
        F.col("id").alias("node"), F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Pages, without html, with host, path, rule, verdict and ``by`` (rule, alias, default).

    ``edges`` are (from_url, to_url) rows from elsewhere, such as a crawler's redirect
    log; they come on top of the links in ``html``.
    """
    keys = [c for c in pages.columns if c not in ("html", "host", "path", "rule", "verdict", "by")]
    rows = pages.select(*keys).withColumns({
        "host": host_of(F.col("url")), "path": path_of(F.col("url")), "_node": node_of(F.col("url")),
    })
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    own = rule_verdicts(rows.select(F.col("_row").alias("key"), "host", "path"), rules)
    linked = page_edges(pages)
    if edges is not None:
        linked = linked.unionByName(edges.select("from_url", "to_url"))
    aliases = alias_verdicts(linked, rules).select(
        F.col("node").alias("_node"), F.col("verdict").alias("_by_alias")
    )
    own = own.select(F.col("key").alias("_row"), "rule", F.col("verdict").alias("_by_rule"))
    judged = rows.join(own, "_row", "left").join(aliases, "_node", "left")
    return judged.select(
        *keys, "host", "path", "rule",
        F.coalesce("_by_rule", "_by_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("_by_rule").isNotNull(), "rule").when(F.col("_by_alias").isNotNull(), "alias")
        .otherwise("default").alias("by"),
    )
