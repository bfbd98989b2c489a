"""URL filter: a tree of path templates per host, judged by smoothed labelled purity.

Digits and hexadecimal names in path segments are masked, and urls are counted by host and masked
path. The tree grows from the host downwards, one level of segments at a time:

* a segment that holds too small a share of its branch is variable and becomes the wildcard ``*``;
* branches of one parent that agree in how they go on and in their labels, as far as a Hoeffding bound
  can tell, become one branch ``{a|b}``;
* a branch's purity is its share of good labels, smoothed towards the purity of its parent.

A url whose template has too low a purity is blocked, unless a rule for its host and path decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.session import scratch_dir, written

DEPTH = 12  # levels of a tree; all segments from there on are the one segment ``**``
KEEP_ROWS, KEEP_SHARE = 8, 64  # a literal segment has so many urls and at least 1/64 of its parent's
ALPHA = 0.05  # of the Hoeffding bound
STRENGTH, PRIOR = 8.0, 0.5  # labels that the parent's purity counts for; purity above all hosts
LEAST_PURITY = 0.5
HOT = 1_000  # leaves with at least 1/1000 of all urls; there are 1000 at most
KINDS = 7  # ways a branch can go on, see _kind

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null url and one without ``://``."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(there, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``; null if none does.

    A rule ``(verdict, host/path)`` fits its host and all subdomains where the path starts with the rule's
    path. Of rules of equal length the one first in code-point order wins.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + tail))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def masked(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with hexadecimal names and runs of digits masked; none for an empty path.

    Characters that templates use themselves are masked too.
    """

    def mask(segment: Column) -> Column:
        plain = F.regexp_replace(F.translate(segment, "{}|*<>", "~~~~~~"), "[0-9]+", "#")
        return F.when(F.regexp_like(segment, F.lit("^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F-]{8,}$")), "<hex>").otherwise(plain)

    parts = F.split(path, "/", -1)
    segments = F.slice(parts, F.lit(2), F.size(parts))
    cut = F.when(F.size(segments) > depth, F.array_append(F.slice(segments, 1, depth - 1), F.lit("**"))).otherwise(segments)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(cut, lambda s, i: F.when((F.size(segments) > depth) & (i == depth - 1), s).otherwise(mask(s)))
    )


def _kind(segment: Column) -> Column:
    """How a branch goes on: 0 ends, 1 empty, 2 number, 3 with a number, 4 hexadecimal, 5 with a dot, 6 plain."""
    return (
        F.when(segment.isNull(), 0).when(segment == "", 1).when(segment == "#", 2).when(F.contains(segment, F.lit("#")), 3)
        .when(segment == "<hex>", 4).when(F.contains(segment, F.lit(".")), 5).otherwise(6)
    )


def _smoothed(good: Column, bad: Column, parent: Column, strength: float) -> Column:
    return (good + parent * strength) / (good + bad + strength)


def _similar(a: Column, b: Column, alpha: float) -> Column:
    """Whether two branches' labels and continuations agree within the Hoeffding bound."""
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(x: Column, n: Column, y: Column, m: Column) -> Column:
        bound = width * (1 / F.sqrt(n) + 1 / F.sqrt(m))
        return (n == 0) | (m == 0) | (F.abs(x / F.nullif(n, F.lit(0)) - y / F.nullif(m, F.lit(0))) <= bound)

    same = agree(a["good"], a["good"] + a["bad"], b["good"], b["good"] + b["bad"])
    for i in range(KINDS):
        same = same & agree(a["goes"][i], a["n"], b["goes"][i], b["n"])
    return same


def _merged(children: Column, alpha: float) -> Column:
    """Groups of similar branches: each, from the largest down, joins the first group it agrees with."""
    group = "struct<names: array<string>, n: bigint, good: bigint, bad: bigint, goes: array<bigint>>"

    def add(groups: Column, c: Column) -> Column:
        own = F.struct(F.array(c["seg"]).alias("names"), c["n"].alias("n"), c["good"].alias("good"), c["bad"].alias("bad"), c["goes"].alias("goes"))

        def put(at: Column) -> Column:
            def into(g: Column, i: Column) -> Column:
                both = F.struct(
                    F.concat(g["names"], own["names"]).alias("names"), (g["n"] + c["n"]).alias("n"), (g["good"] + c["good"]).alias("good"),
                    (g["bad"] + c["bad"]).alias("bad"), F.zip_with(g["goes"], c["goes"], lambda x, y: x + y).alias("goes"),
                )
                return F.when(i + 1 == at, both).otherwise(g)

            return F.when(at == 0, F.array_append(groups, own)).otherwise(F.transform(groups, into))

        first = F.array_position(F.transform(groups, lambda g: _similar(g, own, alpha)), F.lit(True))
        return F.element_at(F.transform(F.array(first), put), 1)

    return F.aggregate(children, F.array().cast(f"array<{group}>"), add)


def _level(leaves: DataFrame, at: int, alpha: float, strength: float) -> DataFrame:
    """Leaves with one more level of their template, and the purity of that branch."""
    node = ["host", "template"]
    going = leaves.where(F.size("segments") > at).withColumns({
        "seg": F.element_at("segments", at + 1), "kind": _kind(F.get("segments", F.lit(at + 1))),
    })
    goes = F.array(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)) for i in range(KINDS)])
    children = written(
        going.groupBy(*node, "purity", "seg").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), goes.alias("goes")),
        scratch_dir(leaves.sparkSession, "children"),
    )
    totals = children.groupBy(*node).agg(F.sum("n").alias("total"))
    # At most KEEP_SHARE segments of a parent can hold that share.
    literal = children.where(F.col("n") >= KEEP_ROWS).join(totals, node).where(F.col("n") * KEEP_SHARE >= F.col("total"))
    largest_first = F.array_sort(
        F.collect_list(F.struct("seg", "n", "good", "bad", "goes")),
        lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["seg"] < b["seg"], -1).otherwise(1),
    )
    groups = literal.groupBy(*node).agg(largest_first.alias("all")).select(*node, F.explode(_merged(F.col("all"), alpha)).alias("g"))
    name = F.when(F.size("g.names") == 1, F.element_at("g.names", 1)).otherwise(
        F.concat(F.lit("{"), F.array_join(F.array_sort("g.names"), "|"), F.lit("}"))
    )
    names = groups.select(*node, name.alias("name"), F.explode("g.names").alias("seg"))
    named = children.join(names, [*node, "seg"], "left").withColumn("name", F.coalesce("name", F.lit("*")))
    branches = named.groupBy(*node, "name").agg(
        _smoothed(F.sum("good"), F.sum("bad"), F.first("purity"), strength).alias("own")
    )
    below = named.select(*node, "seg", "name").join(branches, [*node, "name"])
    moved = going.drop("seg", "kind", "purity").withColumn("seg", F.element_at("segments", at + 1)).join(below, [*node, "seg"])
    step = moved.select(
        "host", "segments", F.concat("template", F.lit("/"), "name").alias("template"), "n", "good", "bad", F.col("own").alias("purity")
    )
    return leaves.where(F.size("segments") <= at).unionByName(step)


def templates(counted: DataFrame, alpha: float = ALPHA, strength: float = STRENGTH, prior: float = PRIOR) -> DataFrame:
    """The template and purity of every ``host, segments`` with its counts ``n, good, bad``."""
    spark = counted.sparkSession
    hosts = counted.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    hosts = written(hosts, scratch_dir(spark, "hosts"))
    top = hosts.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    whole = (top["g"] + prior * strength) / (top["g"] + top["b"] + strength)
    roots = hosts.select("host", _smoothed(F.col("g"), F.col("b"), F.lit(whole), strength).alias("purity"))
    leaves = written(
        counted.join(roots, "host").select("host", "segments", F.lit("").alias("template"), "n", "good", "bad", "purity"),
        scratch_dir(spark, "leaves"),
    )
    deepest = leaves.agg(F.max(F.size("segments"))).first()[0] or 0
    for at in range(deepest):
        leaves = written(_level(leaves, at, alpha, strength), scratch_dir(spark, "leaves"))
    return leaves


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = (), good: Column | None = None, least_purity: float = LEAST_PURITY,
    depth: int = DEPTH, alpha: float = ALPHA, strength: float = STRENGTH, prior: float = PRIOR,
) -> DataFrame:
    """Verdict of every url: ``page_id, host, path, rule, verdict, template, purity``.

    Takes ``page_id, url``. ``good`` is the label of a row: true, false or null for none. The verdict is
    ``allow`` or ``block``, that of the longest fitting rule, else ``block`` where the purity of the url's
    template is below ``least_purity``. Without labels all purities are ``prior``.

    A null url and one without ``://`` have empty host and path and share one tree. Every row is judged and repeated
    rows count as often as they appear; urls of any length are read whole, with all segments after
    ``depth - 1`` as one. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    label = F.lit(None).cast("boolean") if good is None else good
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), label.alias("good"))
    rows = written(parsed.withColumn("segments", masked(F.col("path"), depth)), scratch_dir(spark, "urls"))
    counted = written(
        rows.groupBy("host", "segments").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")
        ),
        scratch_dir(spark, "paths"),
    )
    key = ["host", "segments"]
    grown = templates(counted, alpha, strength, prior).select(*key, "template", "purity", "n")
    # A path that a large share of all urls have is met by broadcast, so that none of them lands in one task.
    many = (counted.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = grown.where(F.col("n") >= many).drop("n")
    met = rows.join(F.broadcast(hot), key, "left")
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(grown.where(F.col("n") < many).drop("n"), key)
    judged = met.where(F.col("template").isNotNull()).unionByName(rest)
    decided = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return decided.select(
        "page_id", "host", "path", "found.rule", F.coalesce("found.verdict", own).alias("verdict"), "template", "purity"
    )
