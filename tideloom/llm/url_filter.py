"""URL filters with redirect equivalence.

Rules allow or block a host, its subdomains and a path prefix; the longest that fits a url decides.  Urls without a
rule take the decision of their aliases: pages joined by canonical links and meta redirects form components
(distributed, see ``components``), and a component with a blocked member blocks its members without a rule of their
own, unless one of its members is explicitly allowed.  Urls that only appear as targets count as members too.

Rules are a table: a url's host gives the suffixes that rules can name, each suffix the lengths of paths that its rules
have, and (suffix, path of that length) is looked up by an equi-join, so work doesn't grow with the number of rules.  The
rule table is broadcast up to ``BROADCAST`` bytes and joined by key beyond that.

Urls are compared without their fragment, scheme and host in lower case.  Links inside comments, scripts and styles
don't count; relative links are resolved against the page.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; null html has no links;
pages that repeat a url share its verdict; each row gives one row; an empty table gives none.
"""

from __future__ import annotations

import html as html_entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, durable
from .components import connected_components

#: (host, path, action)
Rule = tuple[str, str, str]
#: Bytes of rules that may be broadcast.
BROADCAST = 32 << 20

_OPENS = re.compile(r"<!--|<script\b|<style\b", re.I)
_CLOSES = {"<!--": re.compile("-->"), "<script": re.compile(r"</script\s*>", re.I), "<style": re.compile(r"</style\s*>", re.I)}
_TAG = re.compile(r"<(link|meta)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_REFRESH = re.compile(r"^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", re.I)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    head, tail = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)([^#]*)", 1), F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)([^#]*)", 2)
    return F.when(head != "", F.concat(F.translate(head, UPPER, UPPER.lower()), tail))


def ranked(rules: list[Rule]) -> list[Rule]:
    """Shorter rules first; of one length, allow after block, so that it prevails."""
    return sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r))


def decided(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` (with host and path) and the ``rule`` that decides and its ``action``; null where none fits."""
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    rows = [(h, p, k, h + p, action) for k, (h, p, action) in enumerate(ranked(rules))]
    table = df.sparkSession.createDataFrame(rows, "_h string, _p string, _rank int, rule string, action string")
    small = sum(len(h) + len(p) + 100 for h, p, _ in rules) <= BROADCAST
    sent = F.broadcast if small else (lambda t: t)
    labels = max(h.count(".") + 1 for h, _, _ in rules)  # longer suffixes are no rule's host
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    lengths = table.groupBy("_h").agg(F.collect_set(F.char_length("_p")).alias("_ns"))
    found = df.select("host", "path").distinct().withColumn("_h", F.explode(tails)).join(sent(lengths), "_h")
    found = found.withColumn("_n", F.explode("_ns")).where(F.col("_n") <= F.char_length("path")).withColumn("_p", F.expr("substring(path, 1, _n)"))
    found = found.join(sent(table), ["_h", "_p"]).groupBy("host", "path").agg(F.max(F.struct("_rank", "rule", "action")).alias("_best"))
    return df.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")


def visible(html: str) -> str:
    """Without comments, scripts and styles; what is never closed stays.  Every close is searched for once."""
    out, at, endless = [], 0, set()
    for opened in _OPENS.finditer(html):
        kind = opened[0].lower()
        if opened.start() < at or kind in endless:
            continue
        closed = _CLOSES[kind].search(html, opened.end())
        if closed is None:
            endless.add(kind)
            continue
        out.append(html[at : opened.start()])
        at = closed.end()
    return " ".join([*out, html[at:]])


def links_in(url: str, html: str) -> list[str]:
    """Targets of a page's canonical links and meta redirects, resolved."""
    out = []
    for m in _TAG.finditer(visible(html)):
        own = {a[0].lower(): html_entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[2])}
        target = None
        if m[1].lower() == "link" and "canonical" in own.get("rel", "").lower().split():
            target = own.get("href")
        elif m[1].lower() == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(own.get("content", ""))
            target = found[1] if found else None
        if target and target.strip():
            try:
                out.append(urljoin(url, target.strip()))
            except ValueError:
                continue
    return out


def _links(batches):
    for pages in batches:
        pairs = [(u, t) for u, h in zip(pages["url"], pages["html"]) for t in links_in(u, h)]
        yield pd.DataFrame(pairs, columns=["url", "target"], dtype=object)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) between urls as nodes; pages without such tags never leave the JVM."""
    tagged = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")
    found = tagged.mapInPandas(_links, "url string, target string")
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b")


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict."""
    placed = lambda df, url: df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    aliases = connected_components(alias_edges(pages))
    members = decided(placed(aliases, "node"), rules)
    standing = members.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("_blocked"),
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("_allowed"),
    )
    blocked = aliases.join(standing.where(F.col("_blocked") & ~F.col("_allowed")), "component").select(F.col("node").alias("_alias"))
    blocked = durable(blocked, "blocked-aliases")
    own = placed(pages.select("page_id", "url"), "url").withColumn("_node", node_of(F.col("url"))).drop("url")
    judged = decided(own, rules).join(blocked, F.col("_node") == F.col("_alias"), "left")
    verdict = F.coalesce("action", F.when(F.col("_alias").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
