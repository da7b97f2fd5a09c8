"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

DataFrame expressions only.  Features are length, depth, digit ratio, character
entropy, parameter count, hyphens, host labels, host length, and two statistics of
the host's suffix (block rate and row count among the training URLs).  Training
URLs (a bounded number, see ``train``) are binned by Spark and grouped into
distinct bin vectors with their label counts; the driver grows the trees from
these, and all rows are scored by the trees as one expression.

Defined cases: a null url, or one without ``://``, has empty host and path, still
gets features, and is judged by the trees; without training rows of both classes
every margin is the prior's; empty tables give empty results; other columns stay,
whatever their names, but for those of OUTPUTS, which are replaced; repeated rows are
judged alike; very long urls are judged whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import written

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(F.translate(host, UPPER, LOWERED), F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_column(rules: list[Rule]) -> Column:
    """The text of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last to be put on top wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


OUTPUTS = ("host", "path", "rule", "verdict", "block_score")
FEATURES = ("url_chars", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "host_chars", "suffix_rate", "suffix_rows")


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    parts = F.array_distinct(F.split(u, ""))
    share = F.transform(F.filter(parts, lambda c: c != ""), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    return df.withColumns(
        {
            "url_chars": n.cast("double"),
            "depth": count(F.col("path"), "/"),
            "digit_ratio": F.when(n > 0, F.length(F.regexp_replace(u, "[^0-9]", "")) / n).otherwise(0.0),
            "entropy": F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
            "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
            "hyphens": count(F.col("host"), "-"),
            "labels": F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), ".") + 1.0),
            "host_chars": F.length("host").cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


@dataclass
class Trees:
    """prior log-odds, and trees of ((feature, threshold), ...) levels by node: a node goes right above its threshold."""

    prior: float = 0.0
    trees: list[dict] = field(default_factory=list)

    def margin(self, of=F.col) -> Column:
        def walk(tree: dict, node: int) -> Column:
            if node not in tree["splits"]:
                return F.lit(float(tree["leaves"].get(node, 0.0)))
            name, cut = tree["splits"][node]
            return F.when(of(name) > F.lit(cut), walk(tree, 2 * node + 1)).otherwise(walk(tree, 2 * node))

        out = F.lit(float(self.prior))
        for t in self.trees:
            out = out + walk(t, 1)
        return out


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_rows: int = 20_000, n_trees: int = 12, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0) -> tuple[Trees, DataFrame]:
    """The trees, and (suffix, suffix_rate, suffix_rows), of at most max_rows rows.

    max_rows bounds the labelled rows that are learned from (those of smallest hash
    of the url); all rows of the table to judge are judged.
    """
    rows = labelled.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.coalesce(F.col(url), F.lit("")))).orderBy("_h").limit(max_rows)
    rows = written(with_features(with_parts(rows.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")))).drop("url"), "urls")
    base = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((base[1] + 1.0) / (base[0] - base[1] + 1.0))
    suffixes = rows.groupBy("suffix").agg(((F.sum("label") + F.lit(10.0 * (base[1] + 1) / (base[0] + 2))) / (F.count(F.lit(1)) + 10.0)).alias("suffix_rate"), F.count(F.lit(1)).cast("double").alias("suffix_rows"))
    suffixes = written(suffixes, "suffixes")
    model = Trees(prior)
    if not 0 < base[1] < base[0]:
        return model, suffixes
    rows = rows.join(F.broadcast(suffixes), "suffix")  # max_rows suffixes at most
    marks = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    # A row keeps, for each feature, the largest cut below it; splits compare with cuts, so nothing is lost.
    binned = rows.select("label", *(sum(((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES))
    # At most max_rows distinct bin vectors come to the driver.
    vectors = [(tuple(r[:-2]), r[-2], r[-1]) for r in binned.groupBy(*FEATURES).agg(F.count(F.lit(1)), F.sum("label")).collect()]
    margins = [prior] * len(vectors)
    for _ in range(n_trees):
        rates = [1 / (1 + math.exp(-m)) for m in margins]
        gh = [(pos - n * p, n * p * (1 - p)) for (_, n, pos), p in zip(vectors, rates, strict=True)]
        tree: dict = {"splits": {}, "leaves": {}}
        members = {1: range(len(vectors))}
        while members:
            node, own = members.popitem()
            g, h = (sum(gh[i][k] for i in own) for k in (0, 1))
            best = (1e-6, None)
            for k, f in enumerate(FEATURES) if node < 2**depth else ():
                by_bin = [[0.0, 0.0] for _ in range(len(cuts[f]) + 1)]
                for i in own:
                    x = by_bin[vectors[i][0][k]]
                    x[0] += gh[i][0]
                    x[1] += gh[i][1]
                gl = hl = 0.0
                for b in range(len(cuts[f])):
                    gl, hl = gl + by_bin[b][0], hl + by_bin[b][1]
                    if min(hl, h - hl) < 1.0:
                        continue
                    gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                    if gain > best[0]:
                        best = (gain, (k, b))
            if best[1]:
                k, b = best[1]
                tree["splits"][node] = (FEATURES[k], cuts[FEATURES[k]][b])
                members[2 * node] = [i for i in own if vectors[i][0][k] <= b]
                members[2 * node + 1] = [i for i in own if vectors[i][0][k] > b]
            else:
                tree["leaves"][node] = rate * g / (h + l2)
                for i in own:
                    margins[i] += tree["leaves"][node]
        if not tree["splits"]:
            break
        model.trees.append(tree)
    return model, suffixes


def judge(df: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url: str = "url", **options) -> DataFrame:
    """df with host, path, rule, verdict and block_score.

    labelled: (url, label) with label 1 for block; by default the rows of df that a
    rule judges, labelled by its verdict.
    """
    names = [f"c{k}" for k in range(len(df.columns))]  # whatever df's columns are called
    own = names[df.columns.index(url)]
    parts = with_parts(df.toDF(*names), own).withColumn("rule", rule_column(rules))
    blocks = [r.text for r in rules if r.verdict == "block"]
    if labelled is None:
        labelled = parts.where(F.col("rule").isNotNull()).select(F.col(own).alias("url"), F.col("rule").isin(*blocks).cast("int").alias("label"))
        model, suffixes = train(labelled, **options)
    else:
        model, suffixes = train(labelled, url, **options)
    rated = with_features(parts, own).join(F.broadcast(suffixes), "suffix", "left")  # max_rows suffixes at most
    prior = 1 / (1 + math.exp(-model.prior))
    rated = rated.fillna({"suffix_rate": prior, "suffix_rows": 0.0}).withColumn("block_score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(*blocks), "block").otherwise("allow")).otherwise(F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    kept = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c not in OUTPUTS]
    return rated.withColumn("verdict", verdict).select(*kept, *OUTPUTS)
