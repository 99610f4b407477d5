"""URL verdicts: rules first, else a tree of path templates with smoothed labelled purity (operator 2).

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import written

#: (verdict, host and path): the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Segments told apart below a node; a deeper path counts as one with its rest as the last segment.
DEPTH = 4
#: A node's children are variable if it has so many values at least, and so large a share of its rows that differ.
VALUES, SHARE = 16, 0.1
#: Siblings whose labelled shares differ by at most Z standard errors of the difference are alike.
Z = 2.58
#: Rows that the share of the level above counts for, and the purity below which a template is rejected.
PRIOR, PURITY = 8.0, 0.5
#: How the names of merged branches begin, which no literal and no wildcard does; the share of bad rows in thousandths follows, if known.
MERGED = "**"
#: Endings of pages' names.
EXTENSION = r"\.(?:html?|php|aspx?|jsp|xml|json|pdf|txt)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none does. A rule fits its host and all subdomains."""
    rule = verdict = None
    for what, name in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, below = name.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def _shape(segment: Column) -> Column:
    """Of a variable segment: each number becomes {n}, each run of other characters up to . _ or - a *, and *s one after the other
    one *; a page's extension stays. So it never has two *s side by side."""
    ending = F.regexp_extract(segment, f"({EXTENSION})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(ending))
    stars = F.regexp_replace(F.regexp_replace(stem, "[0-9]+", "\u0001"), "[^\u0001._-]+", "*")
    return F.concat(F.replace(F.regexp_replace(stars, "[*]([._-]+[*])+", "*"), F.lit("\u0001"), F.lit("{n}")), ending)


def _segments(path: Column, depth: int) -> Column:
    """The path's segments that aren't empty, `depth` at most, the rest being one. Before a character that templates use, \\ * { or },
    stands a \\."""
    found = F.filter(F.split(F.regexp_replace(path, r"([\\*{}])", r"\\$1"), "/"), lambda s: s != "")
    return F.when(F.size(found) > depth, F.concat(F.slice(found, 1, depth - 1), F.array(F.array_join(F.slice(found, depth, 2**31 - 1), "/")))).otherwise(found)


def templates(pages: DataFrame, depth: int = DEPTH, values: int = VALUES, share: float = SHARE) -> DataFrame:
    """pages (with host and path) with a column more: the path's template, an array of segments, level by level from each host's root.

    Where the distinct values below a node are many, and many for its rows, the segment is variable and becomes a wildcard; so
    does one of digits alone. Each level is one count of (node, segment) and one join with the variable nodes, which are few.
    """
    rows = pages.withColumn("_segments", _segments(F.col("path"), depth)).withColumn("template", F.array().cast("array<string>"))
    for level in range(depth):
        rows = rows.withColumn("_s", F.get("_segments", F.lit(level)))
        children = rows.where("_s is not null").groupBy("host", "template", "_s").agg(F.count(F.lit(1)).alias("n"))
        nodes = children.groupBy("host", "template").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        variable = written(nodes.where((F.col("k") >= values) & (F.col("k") >= share * F.col("n"))).select("host", "template", F.lit(True).alias("_variable")), "variable")
        rows = rows.join(variable, ["host", "template"], "left")
        wild = F.coalesce("_variable", F.lit(False)) | F.col("_s").rlike("^[0-9]+$")
        next_ = F.concat("template", F.array(F.when(wild, _shape(F.col("_s"))).otherwise(F.col("_s"))))
        rows = rows.withColumn("template", F.when(F.col("_s").isNull(), F.col("template")).otherwise(next_)).drop("_variable", "_s")
    return rows.drop("_segments")


def _alike(siblings: Column, z: float) -> Column:
    """Array of (l, b, low): for each (l, b), in order of share, the first entry of its set. A set takes the next sibling while that is alike
    to all that the set holds together: two shares, pooled for their error."""
    last = lambda s: F.element_at(s["done"], -1)

    def step(s: Column, x: Column) -> Column:
        p = (s["b"] + x["b"] + 0.5) / (s["l"] + x["l"] + 1)
        near = F.abs(s["b"] / s["l"] - x["b"] / x["l"]) <= z * F.sqrt(p * (1 - p) * (1 / s["l"] + 1 / x["l"]))
        joins = F.coalesce((s["l"] > 0) & near, F.lit(False))
        low = F.when(joins, last(s)["low"]).otherwise(x["i"])
        return F.struct(
            F.concat(s["done"], F.array(F.struct(x["l"].alias("l"), x["b"].alias("b"), low.alias("low")))).alias("done"),
            F.when(joins, s["l"] + x["l"] * x["n"]).otherwise(x["l"] * x["n"]).alias("l"), F.when(joins, s["b"] + x["b"] * x["n"]).otherwise(x["b"] * x["n"]).alias("b"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.array().cast("array<struct<l:bigint,b:bigint,low:int>>").alias("done"), zero.alias("l"), zero.alias("b"))
    numbered = F.transform(siblings, lambda x, i: F.struct(i.alias("i"), x["l"].alias("l"), x["b"].alias("b"), x["n"].alias("n")))
    return F.aggregate(numbered, start, step)["done"]


def merged(stats: DataFrame, depth: int = DEPTH, z: float = Z) -> DataFrame:
    """(host, template) -> branch, over a table of (host, template, labelled, bad), one row each; both are arrays of segments.

    From the root down, siblings in order of their share of bad rows are put together while they are alike. A set of several is one
    branch from then on: its children are each other's siblings, those of one name being one. Siblings without labels are a branch
    of their own. A sibling that is alike to no other keeps its name. Siblings of equal counts are alike and stand as one entry, so what
    a parent gathers are the different counts of its children, not the children.
    """
    found = stats.select("host", "template", F.col("template").alias("branch"), "labelled", "bad")
    for level in range(1, depth + 1):
        deep = found.where(F.size("branch") >= level).withColumns({"up": F.slice("branch", 1, level - 1), "at": F.get("branch", F.lit(level - 1))})
        branches = deep.groupBy("host", "up", "at").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        counts = branches.groupBy("host", "up", "l", "b").agg(F.count(F.lit(1)).alias("n"))
        entries = F.array_sort(F.collect_list(F.when(F.col("l") > 0, F.struct((F.col("b") / F.col("l")).alias("share"), "l", "b", "n"))))
        sets = counts.groupBy("host", "up").agg(entries.alias("e")).select("host", "up", F.explode(_alike(F.col("e"), z)).alias("m")).select("host", "up", "m.*")
        sized = counts.join(sets, ["host", "up", "l", "b"], "left").withColumn("low", F.coalesce("low", F.lit(-1)))
        together = sized.groupBy("host", "up", "low").agg(F.sum("n").alias("members"), F.sum(F.col("l") * F.col("n")).alias("all_l"), F.sum(F.col("b") * F.col("n")).alias("all_b"))
        thousandths = F.coalesce(F.round(F.try_divide(1000 * F.col("all_b"), F.col("all_l"))).cast("int").cast("string"), F.lit(""))
        named = sized.join(together, ["host", "up", "low"]).where("members > 1").select("host", "up", "l", "b", F.concat(F.lit(MERGED), thousandths).alias("_name"))
        names = branches.join(named, ["host", "up", "l", "b"]).select("host", "up", "at", "_name")
        rest = F.slice("branch", level + 1, 2**31 - 1)
        renamed = deep.join(names, ["host", "up", "at"], "left").withColumn("branch", F.concat("up", F.array(F.coalesce("_name", "at")), rest))
        found = written(renamed.select(found.columns).unionByName(found.where(F.size("branch") < level)), "branches")
    return found.select("host", "template", "branch")


def purities(branches: DataFrame, hosts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(host, branch, purity) of branches(host, branch, l, b): the smoothed share of good rows among the labelled ones. A branch without labels
    has what its nearest branch above shows that has some."""
    share = lambda bad, labelled, above: (bad + prior * above) / (labelled + prior)
    above = F.transform(F.sequence(F.lit(0), F.size("branch")), lambda n: F.slice("branch", 1, n))
    each = branches.select("host", "branch", "l", "b", F.explode(above).alias("up"))
    sums = each.where("l > 0").groupBy("host", "up").agg(F.sum("l").alias("up_l"), F.sum("b").alias("up_b"))
    near = each.where("l = 0").join(sums, ["host", "up"]).groupBy("host", "branch").agg(F.max_by(F.struct("up_l", "up_b"), F.size("up")).alias("m"))
    known = branches.join(near, ["host", "branch"], "left").withColumns({"l": F.coalesce("m.up_l", "l"), "b": F.coalesce("m.up_b", "b")})
    return known.join(hosts, "host").select("host", "branch", (1 - share(F.col("b"), F.col("l"), F.col("_host"))).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, branch (the template with alike siblings merged), purity.

    labels: (label_key, bad 0/1), one row per key; a page's key is the last number of its path. A page that a rule fits has the
    rule's verdict; any other is blocked if its branch's purity, the share of good rows among the labelled ones, smoothed with
    the host's and that with the share over all pages, is below the limit. A null url, or one without ://, has an empty host
    and path and is judged by what such pages' labels show: nothing, so by the share over all. Null ids and repeated rows stay.
    Null labels don't count; a key labelled both ways is bad. A branch exactly at the limit is allowed, and of rules of one length the
    first by name wins. Other columns are ignored; an empty table gives no rows. A url's segments beyond the depth count as one, so
    very long paths are no special case.
    """
    parts = pages.select(F.col(id_col), F.col(url_col).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}).drop("_url")
    key = F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') as bigint)")
    known = written(labels.where("label_key is not null and bad is not null").groupBy("label_key").agg(F.max("bad").cast("long").alias("_bad")), "page-labels")
    rows = templates(parts.withColumn("label_key", key)).join(known, "label_key", "left").drop("label_key")
    rows = written(rows, "templates")
    stats = rows.groupBy("host", "template").agg(F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    stats = written(stats, "template-stats")
    names = merged(stats)
    share = lambda bad, labelled, above: (bad + prior * above) / (labelled + prior)
    total = stats.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).select(((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 2)).alias("all"))  # one row
    hosts = stats.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hl")).join(F.broadcast(total)).withColumn("_host", share(F.col("hb"), F.col("hl"), F.col("all")))
    branches = written(stats.join(names, ["host", "template"]).groupBy("host", "branch").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")), "branch-stats")
    pure = purities(branches, hosts, prior)
    known_templates = written(names.join(pure, ["host", "branch"]), "purity")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(known_templates, ["host", "template"]).select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") < purity, "block").otherwise("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.concat(F.lit("/"), F.array_join("branch", "/")).alias("branch"), "purity"
    )
