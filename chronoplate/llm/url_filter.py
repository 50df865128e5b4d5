"""URL filters: host and path rules, and a path-template tree learnt from what the pages hold.

Rules decide first. A rule is a host and a path; it fits that host and its subdomains where the path starts with the rule's;
the longest rule that fits wins (of equals, block).

Other urls are judged by the tree. Labels come from the pages, not from the rules: a page whose visible text has fewer than
`least_words` words, or a share of symbols of `most_symbols` or more, is labelled bad, one with other html good; a null html gives
no label. The tree holds, for each host, the segments of all paths, level by level. A segment is a branch of its slot
(host, template so far). Branches whose text is a number, a hash or a mix with digits are variable, and so are rare
branches of a slot with many; these become one wildcard. Then branches that are statistically alike are merged: they
are sorted by smoothed share of bad pages into `BINS` steps of equal variance, and neighbouring steps are one group
unless a two-proportion test tells them apart. Merged branches go on as one slot, so that their children meet. Segments
below the level `deep` are one rest.

A template is rejected if its share of bad pages reaches `reject`. The share is smoothed by `weight` pages of what the same form of path
(variable segments as wildcards) has in the host's domain, that by as many of all hosts, and that by as many of the overall share.
Without a label on any of these levels a template is allowed.

Urls that are null or have no "://" have an empty host and path, fit no rule and are allowed. Repeated urls and page ids are
kept. An empty table gives none. Extra columns don't pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import BLANKS, WORD_SPLIT, ascii_lower_col, dropped, looked_up, written

#: Rows of rules that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rules that are looked up in a literal of the plan.
LITERAL_RULES = 200
#: Steps of the share of bad pages that branches of a slot are grouped from.
BINS = 16
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    rule: str  # host, a slash, and the start of the path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    return ascii_lower_col(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, as an array."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _by_join(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """`urls` and the rules of their host (`rules`), by a join of distinct hosts on domains."""
    listed = urls.sparkSession.createDataFrame([(r.host, r.path, r.rule, r.verdict) for r in rules], "domain string, start string, rule string, verdict string").repartition(1)
    by_domain = listed.groupBy("domain").agg(F.collect_list(F.struct("start", "rule", "verdict")).alias("rules"))
    by_domain = F.broadcast(by_domain) if len(rules) <= BROADCAST_ROWS else by_domain
    hosts = urls.select("host").distinct().withColumn("domain", F.explode(suffixes(F.col("host")))).join(by_domain, "domain").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    return looked_up(urls, written(hosts, "hosts"), ["host"], F.xxhash64("key", "path"))


def _by_literal(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same without a join."""
    kind = "array<struct<start: string, rule: string, verdict: string>>"
    as_struct = lambda r: F.struct(F.lit(r.path).alias("start"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.host, []).append(r)
    if not by:
        return urls.withColumn("rules", F.array().cast(kind))
    known = F.create_map(*(x for d, rs in by.items() for x in (F.lit(d), F.array(*map(as_struct, rs)))))
    return urls.withColumn("rules", F.flatten(F.transform(suffixes(F.col("host")), lambda d: F.coalesce(F.try_element_at(known, d), F.array().cast(kind)))))


def ruled(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """`urls` (with key, host, path) and the winning `rule` struct<size, verdict, rule>, or null."""
    fitting = F.filter("rules", lambda r: F.startswith("path", r["start"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return (_by_literal if len(rules) <= LITERAL_RULES else _by_join)(urls, rules).withColumn("rule", best).drop("rules")


def bad_page(html: Column, least_words: int = 20, most_symbols: float = 0.05) -> Column:
    """Whether a page's visible text is junk; null for a null page."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "), "&amp;", "&")
    words = F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != ""))
    shown = F.length(F.translate(text, BLANKS, ""))
    return (words < least_words) | (F.length(text) - F.length(F.translate(text, SYMBOLS, "")) >= most_symbols * shown)


def shape(segment: Column) -> Column:
    """A placeholder for variable segments, else the segment."""
    return (
        F.when(segment.rlike(r"^\d+(\.[a-z]{2,5})?$"), F.lit("{number}"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$") & segment.rlike(r"\d"), F.lit("{hash}"))
        .when(segment.rlike(r"\d"), F.lit("{mixed}"))
        .otherwise(segment)
    )


def shapes(path: Column, deep: int) -> Column:
    """Shapes of a path's segments, what is below `deep` as one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    cut = F.transform(F.slice(parts, 1, deep), shape)
    return F.when(F.size(parts) > deep, F.concat(cut, F.array(F.lit("{rest}")))).otherwise(cut)


def _alike(b1: Column, n1: Column, b2: Column, n2: Column, similar: float) -> Column:
    """Two-proportion test: whether shares b1 of n1 and b2 of n2 differ by `similar` standard errors at most."""
    share = (b1 + b2 + 0.5) / (n1 + n2 + 1)
    return (n1 == 0) | (n2 == 0) | (F.abs(b1 / F.greatest(n1, F.lit(1)) - b2 / F.greatest(n2, F.lit(1))) <= similar * F.sqrt(share * (1 - share) * (1 / F.greatest(n1, F.lit(1)) + 1 / F.greatest(n2, F.lit(1)))))


_COUNTS = ("n", "labelled", "bad")


def _named(branches: DataFrame, many: int, rare: float, similar: float, weight: float) -> DataFrame:
    """(host, template, branch, name) of the branches of one level: (host, template, branch, n, labelled, bad)."""
    slot = ["host", "template"]
    slots = written(branches.groupBy(*slot).agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"), ((F.sum("bad") + 0.5) / (F.sum("labelled") + 1)).alias("rate")), "slots")
    seen = looked_up(branches, slots, slot, F.col("branch"))
    variable = F.col("branch").startswith("{") | ((F.col("kinds") > many) & (F.col("n") < rare * F.col("all_n")))
    seen = written(seen.withColumn("wild", variable), "seen")
    # The variable branches of a slot are one from here on.
    one = F.when(F.col("wild"), F.lit("*")).otherwise(F.concat(F.lit("="), "branch")).alias("as")
    kinds = seen.groupBy(*slot, one).agg(F.first("rate").alias("rate"), *(F.sum(c).alias(c) for c in _COUNTS))
    share = (F.col("bad") + weight * F.col("rate")) / (F.col("labelled") + weight)
    kinds = written(kinds.withColumn("bin", F.least(F.floor(F.asin(F.sqrt(share)) * (2 / 3.141592653589793) * BINS), F.lit(BINS - 1)).cast("int")), "kinds")
    bins = kinds.groupBy(*slot, "bin").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    steps = bins.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "b"))).alias("steps"))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("b"))

    def fold(acc: Column, x: Column) -> Column:
        joined = (F.size(acc["starts"]) > 0) & _alike(acc["b"], acc["n"], x["b"], x["n"], similar)
        return F.when(joined, F.struct(acc["starts"].alias("starts"), (acc["n"] + x["n"]).alias("n"), (acc["b"] + x["b"]).alias("b"))).otherwise(
            F.struct(F.concat(acc["starts"], F.array(x["bin"])).alias("starts"), x["n"].alias("n"), x["b"].alias("b"))
        )

    groups = written(steps.select(*slot, F.aggregate("steps", start, fold, lambda acc: acc["starts"]).alias("starts")), "groups")
    placed = looked_up(kinds, groups, slot, F.col("as")).withColumn("group", F.array_max(F.filter("starts", lambda s: s <= F.col("bin"))))
    # "*" sorts before all literal branches.
    first = written(placed.groupBy(*slot, "group").agg(F.min("as").alias("first"), F.count("*").alias("size")), "first")
    named = looked_up(placed.select(*slot, "as", "group"), first, [*slot, "group"], F.col("as"))
    name = F.when(F.col("first") == "*", F.lit("*")).otherwise(F.concat(F.substring("first", 2, 1 << 20), F.when(F.col("size") > 1, F.lit("|…")).otherwise(F.lit(""))))
    names = written(named.select(*slot, "as", name.alias("name")), "names")
    out = written(seen.select(*slot, "branch", one).join(names, [*slot, "as"]).select(*slot, "branch", "name"), "named")
    dropped(slots, seen, kinds, groups, first, names)
    return out


def templates(paths: DataFrame, many: int = 20, rare: float = 0.02, similar: float = 2.0, weight: float = 2.0) -> DataFrame:
    """`paths` (host, at, segments, n, labelled, bad), at and segments being a path's shapes as a string and an array, with its `template`.

    `many`: slots with more branches have their rare ones (below the share `rare`) generalised; `similar`: standard errors
    within which shares count as alike."""
    levels = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    tree = written(paths.withColumn("template", F.lit("")), "tree")
    for level in range(levels):
        here = tree.withColumn("branch", F.get("segments", F.lit(level)))
        names = _named(here.filter("branch is not null").groupBy("host", "template", "branch").agg(*(F.sum(c).alias(c) for c in _COUNTS)), many, rare, similar, weight)
        longer = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        below = written(looked_up(here, names, ["host", "template", "branch"], F.col("at")).withColumn("template", longer).drop("branch", "name"), "tree")
        dropped(tree, names)
        tree = below
    return tree


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", reject: float = 0.8, weight: float = 2.0, deep: int = 8, least_words: int = 20, most_symbols: float = 0.05) -> DataFrame:
    """`key`, `host`, `path`, `rule`, `verdict`, `template` and `purity` (smoothed share of bad pages) of every url."""
    bad = bad_page(pages[html], least_words, most_symbols)
    urls = pages.select(pages[key].alias("key"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), bad.alias("bad"))
    urls = ruled(urls, rules).withColumn("segments", shapes(F.col("path"), deep)).withColumn("at", F.array_join("segments", "/"))
    urls = written(urls, "urls")
    # One row for each host and shape of a path: what follows is small beside the pages, and no hot host weighs on it.
    paths = urls.groupBy("host", "at").agg(F.first("segments").alias("segments"), F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    tree = templates(paths, weight=weight)
    form = F.array_join(F.transform("segments", lambda s: F.when(s.startswith("{"), F.lit("*")).otherwise(s)), "/")
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    tree = written(tree.select("host", "at", "template", "labelled", "bad", form.alias("form"), domain.alias("domain")), "nodes")
    total = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    prior = (total["b"] or 0) / (total["n"] or 1)
    sums = lambda by, n, b: tree.groupBy(*by).agg(F.sum("labelled").alias(n), F.sum("bad").alias(b))
    steps = [(["form"], "n2", "b2"), (["domain", "form"], "n1", "b1"), (["host", "template"], "n0", "b0")]
    share, support = F.lit(prior), F.lit(0)
    for by, n, b in steps:
        tree = looked_up(tree, written(sums(by, n, b), n), by, F.xxhash64("host", "at"))
        share = (F.col(b) + weight * share) / (F.col(n) + weight)
        support = support + F.col(n)
    learned = F.when((share >= reject) & (support > 0) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    judged = written(tree.select("host", "at", F.substring("template", 2, 1 << 20).alias("template"), share.alias("purity"), learned.alias("learned")), "judged")
    out = looked_up(urls.select("key", "host", "path", "rule", "at"), judged, ["host", "at"], F.xxhash64("key", "path"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", "learned").alias("verdict"), "template", "purity")
