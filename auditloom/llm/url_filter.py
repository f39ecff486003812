"""URL filter by path-template trees.

Paths are split into segments; numbers and long hexadecimal segments are variable. Level by level,
each node of a host's tree decides which of its segments stay as branches: variable ones are
wildcards; a segment whose labelled share of bad pages is statistically like that of its siblings
together joins the wildcard; one that differs stays, as does the only one with labels, since nothing
says that others are like it; one without labels stays where it does on another host. A labelled node
with one path only keeps that whole path at once (other hosts learn of its next segment), and once no
node is labelled, the rest of every path is wildcards. So there are two rounds more at most than the
labelled paths of a host have levels in common, however long paths are.

Pages then have a template of literal and wildcard segments. A template's purity is its share of bad
labelled pages, smoothed towards the same template over the domain, that towards the same template
over all hosts, that towards the domain, and that towards one half. A template is rejected on labels
only: its purity is over one half, and so is the lower confidence bound of its bad share on the host
or over the domain or, where the domain has no label for it, over all hosts. All else is allowed. The
result names the evidence. Rules, where one fits, come first.

Labels come as a column of the pages; the query takes the rules' own verdicts as labels, since the
tables hold none for pages. Edge cases: a null url or one without :// has an empty host and path;
a segment that is literally * is no wildcard (and is written %2A); repeated rows count each; extra
columns are ignored; an empty table gives no row. A domain is a host's last two labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Segments that are variable, standard errors that make branches differ and bounds hold, weight of the level above.
VARIABLE, APART, PRIOR = r"^[0-9]+$|^[0-9a-fA-F-]{8,}$", 2.0, 2.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """path without its first slash and with * for each variable segment."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")
    return F.array_join(F.transform(segments, lambda x: F.when(x.rlike(VARIABLE), "*").when(x == "*", "%2A").otherwise(x)), "/")


def templates(pages: DataFrame, work: Scratch) -> DataFrame:
    """host, shape, template, lab, bad for pages (host, shape, bad: 1, 0 or null)."""
    # decisions are made on distinct shapes with counts, so a host with very many pages is folded before each shuffle
    paths = pages.groupBy("host", "shape").agg(F.count("bad").alias("lab"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    paths = paths.withColumns({"segs": F.split("shape", "/"), "template": F.lit("")})
    out, node = ("host", "shape", "template", "lab", "bad"), ["host", "template"]
    done, i = [], 0
    while True:
        paths = work.write(paths, "url-paths")  # a level reads the one before three times
        done.append(paths.filter(F.size("segs") <= i).select(*out))
        nodes = paths.filter(F.size("segs") > i).groupBy(*node).agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"), F.count("*").alias("n"))
        rest = paths.join(nodes, node).filter(F.size("segs") > i)
        tail, alone = F.slice("segs", i + 1, F.greatest(F.size("segs") - i, F.lit(1))), (F.col("n") == 1) & (F.col("all_lab") > 0)
        final = F.concat("template", F.lit("/"), F.array_join(F.when(alone, tail).otherwise(F.transform(tail, lambda x: F.lit("*"))), "/"))
        if nodes.filter("all_lab > 0").isEmpty():
            done.append(rest.withColumn("template", final).select(*out))
            return reduce(DataFrame.union, done)
        rest = rest.withColumn("seg", F.get("segs", F.lit(i)))
        done.append(rest.filter(alone).withColumn("template", final).select(*out))
        rest = rest.withColumn("alone", alone)
        kids = rest.groupBy(*node, "seg", "alone", "all_lab", "all_bad").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        rest_lab, rest_bad = F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad")
        here, there = (F.col("bad") + 0.5) / (F.col("lab") + 1), (rest_bad + 0.5) / (rest_lab + 1)
        error = F.sqrt(here * (1 - here) / (F.col("lab") + 1) + there * (1 - there) / (rest_lab + 1))
        differs = (F.col("lab") > 0) & ((rest_lab == 0) | (F.abs(here - there) > APART * error))
        variable = F.col("seg") == "*"
        kids = kids.select(*node, "seg", "alone", ((F.col("lab") == 0) & ~variable).alias("open"), F.when(variable | ~differs, "*").otherwise(F.col("seg")).alias("branch"))
        # where a host has no label for a segment, it stays a branch if it is one on another host
        kept = kids.filter("branch = seg and seg <> '*'").select("template", "seg", F.lit(True).alias("kept")).distinct()
        kids = kids.filter("not alone").join(kept, ["template", "seg"], "left").select(*node, "seg", F.when(F.col("open") & F.col("kept"), F.col("seg")).otherwise(F.col("branch")).alias("branch"))
        i += 1
        paths = rest.filter("not alone").join(kids, [*node, "seg"]).withColumn("template", F.concat("template", F.lit("/"), "branch")).select(*out, "segs")


def low_share(bad: Column, lab: Column) -> Column:
    """Lower bound of the bad share (Wilson's, at APART standard errors); 0 without labels."""
    p, z = bad / lab, APART * APART / lab
    return F.when(lab > 0, (p + z / 2 - F.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)).otherwise(0.0)


def judged(paths: DataFrame) -> DataFrame:
    """host, shape, template, purity, reject and the evidence for paths with template, lab, bad.

    evidence (host, domain, all, or null without labels) says where evidence_pages labelled pages of the
    template, evidence_bad of them bad, were counted, and bound is the lower bound of their bad share.
    """
    paths = paths.withColumn("domain", F.substring_index("host", ".", -2))

    def smoothed(bad: str, lab: str, above: Column) -> Column:
        return (F.col(bad) + PRIOR * above) / (F.col(lab) + PRIOR)

    own = paths.groupBy("domain", "host", "template").agg(F.sum("lab").alias("l1"), F.sum("bad").alias("b1"))
    wide = own.groupBy("domain", "template").agg(F.sum("l1").alias("l2"), F.sum("b1").alias("b2"))
    every = wide.groupBy("template").agg(F.sum("l2").alias("l3"), F.sum("b2").alias("b3"))
    top = wide.groupBy("domain").agg(F.sum("l2").alias("l4"), F.sum("b2").alias("b4"))
    wide = wide.join(top, "domain").join(every, "template")
    wide = wide.withColumn("p2", smoothed("b2", "l2", smoothed("b3", "l3", smoothed("b4", "l4", F.lit(0.5)))))
    own = own.join(wide.select("domain", "template", "l2", "b2", "l3", "b3", "p2"), ["domain", "template"]).withColumn("purity", smoothed("b1", "l1", F.col("p2")))
    bounds = [low_share(F.col(f"b{k}"), F.col(f"l{k}")) for k in (1, 2, 3)]
    at = F.when(F.col("l3") == 0, None).when(F.col("l2") == 0, 3).when(bounds[0] >= bounds[1], 1).otherwise(2)
    own = own.withColumn("at", at).withColumn("bound", F.coalesce(F.get(F.array(*bounds), F.col("at") - 1), F.lit(0.0)))

    def there(*of) -> Column:
        return F.get(F.array(*of), F.col("at") - 1)

    own = own.select(
        "host", "template", "purity", ((F.col("purity") > 0.5) & (F.col("bound") > 0.5)).alias("reject"), there(*map(F.lit, ("host", "domain", "all"))).alias("evidence"),
        F.coalesce(there("l1", "l2", "l3"), F.lit(0)).alias("evidence_pages"), F.coalesce(there("b1", "b2", "b3"), F.lit(0)).alias("evidence_bad"), "bound")
    return paths.select("host", "shape", "template").join(own, ["host", "template"])


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, evidence, evidence_pages, evidence_bad, bound for every row of pages (page_id, url).

    labels (page_id, bad: 0 or 1), one row a page, take the place of the rules' verdicts as labels.
    """
    work = Scratch(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), shape(path).alias("shape"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    if labels is None:
        seen = rows.withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    else:
        seen = rows.join(labels.select("page_id", "bad"), "page_id", "left")
    scored = judged(templates(seen.select("host", "shape", "bad"), work))
    verdict = F.coalesce("said", F.when(F.col("reject"), "block").otherwise("allow"))
    out = rows.join(scored, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "evidence", "evidence_pages", "evidence_bad", "bound")
    out = work.write(out, "urls")
    work.clear(but=out)
    return out
