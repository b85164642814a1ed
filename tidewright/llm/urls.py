"""URL filters: rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains of it if the url's path starts with the prefix, and the
longest fitting rule decides (of equally long ones that with the longer host; of equal ones the last given). Other urls are judged by
trees boosted on the logistic loss, trained from labelled urls; without any the urls the rules judge are the labelled ones. Features are
length, path depth, digit ratio, entropy of the characters, number of parameters, hyphens, host labels, and two statistics each of the
host's suffix and of the path's first directory: how many urls have it, and the share of blocked ones among the labelled urls that have
it, drawn towards the mean of all by `PRIOR` urls; both are `UNLABELLED` where no labelled url has it. A labelled url's own fold of `FOLDS` is
left out of its share, so trees do not learn from an answer they are given; and one fold is shown to them as if its suffixes had no
labels, another as if its directories had none, so that they learn to judge such urls by the rest. Each tree sees `SHOWN` of the
features, in turn, so that urls are told apart by more than the strongest one.

Features are rounded, and cut into at most `BINS` bins at exact quantiles of the labelled urls; equal binned rows are aggregated once,
so a round of boosting costs a sum over distinct rows, and only sums by node, feature and bin, a fixed number, reach the driver. Sums
are of rounded integers: reruns give the same trees.

Defined results: a null url, and one without `://`, has empty host and path, no rule, and is judged by its other features; a
table without labelled urls, or with one label only, gives that label's verdict (allow if none); rows repeat independently;
further columns are kept apart by name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import written

BINS, TREES, DEPTH, RATE, LAMBDA, SHOWN, FOLDS = 16, 12, 3, 0.3, 1.0, 5, 5
#: Labelled urls of the mean label that each suffix is taken to have besides its own.
PRIOR = 20.0
#: The statistics of a suffix or directory that no labelled url has, and the fold that is shown each of the two so.
UNLABELLED, HIDDEN = -1.0, {"tail": 0, "top": 1}
#: Rules up to which they are tested in one expression; more are joined by host.
INLINE = 100
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "tail_share", "tail_count", "top_share", "top_count"]
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWERED)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    at = rule.index("/")
    return rule[:at], rule[at:]


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (with host and path) and `rule`, `rule_verdict` (null where none fits). rules: (host and path, verdict)."""
    ordered = sorted(dict(rules).items(), key=lambda r: (-len(r[0]), -r[0].index("/")))
    if len(ordered) <= INLINE:
        fits = [(rule, verdict, ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)) for rule, verdict in ordered for h, p in [_split(rule)]]
        none = F.lit(None).cast("string")
        return pages.withColumns(
            {name: F.coalesce(*(F.when(fit, F.lit(values[i])) for *values, fit in fits), none) for i, name in enumerate(("rule", "rule_verdict"))}
        )
    known = pages.sparkSession.createDataFrame([(*_split(rule), rule, verdict) for rule, verdict in ordered], "rule_host string, rule_path string, rule string, rule_verdict string")
    places = pages.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = places.withColumn("rule_host", F.explode(suffixes)).join(known, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict")).alias("m")).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "m.rule", "m.rule_verdict")
    return pages.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def features(url: str = "url") -> dict[str, Column]:
    """All but the suffix's, which needs labels."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(n, F.lit(1))
    entropy = F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(F.col("path"), "/"), lambda x: x != "")).cast("double"),
        "digits": F.when(n > 0, F.round(F.length(F.regexp_replace(text, "[^0-9]", "")) / n, 3)).otherwise(0.0),
        "entropy": F.round(entropy, 3),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "hyphens": F.length(F.regexp_replace(text, "[^-]", "")).cast("double"),
        "labels": F.when(F.col("host") == "", 0.0).otherwise(F.size(F.split("host", r"\.")).cast("double")),
    }


def suffix() -> Column:
    return F.regexp_extract("host", r"([^.]*)$", 1)


def directory() -> Column:
    """The path's first directory; empty if the path has none."""
    return F.regexp_extract("path", r"(?s)^/([^/]*)/", 1)


class Trees:
    """Boosted trees over columns b0, b1, ... of bin numbers; a tree is a list of (node, feature, bin) splits and {leaf: value}."""

    def __init__(self, cuts: list[list[float]], base: float):
        self.cuts, self.base = cuts, base
        self.trees: list[tuple[dict[int, tuple[int, int]], dict[int, float]]] = []

    def bins(self) -> list[Column]:
        names = [*(F.col(f"f_{x}") for x in FEATURES)]
        return [reduce(lambda a, b: a + b, ((c > F.lit(cut)).cast("int") for cut in cuts), F.lit(0)) for c, cuts in zip(names, self.cuts, strict=True)]

    @staticmethod
    def node(splits: dict[int, tuple[int, int]], at: int = 1) -> Column:
        """The number of the leaf a row falls into; a node's children are 2n and 2n + 1."""
        if at not in splits:
            return F.lit(at)
        feature, bin_ = splits[at]
        return F.when(F.col(f"b{feature}") <= bin_, Trees.node(splits, 2 * at)).otherwise(Trees.node(splits, 2 * at + 1))

    def _value(self, splits: dict[int, tuple[int, int]], leaves: dict[int, float], at: int = 1) -> Column:
        if at not in splits:
            return F.lit(leaves.get(at, 0.0))
        feature, bin_ = splits[at]
        return F.when(F.col(f"b{feature}") <= bin_, self._value(splits, leaves, 2 * at)).otherwise(self._value(splits, leaves, 2 * at + 1))

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, (self._value(*t) for t in self.trees), F.lit(self.base))


def _with_shares(rows: DataFrame, kind: str, mean: float) -> DataFrame:
    """rows (with f_{kind}, f_fold and y) and f_{kind}_share and f_{kind}_count. Sums are a row for each key and fold; rows meet them by
    both, so that a key a third of all urls share is FOLDS groups, which Spark splits further where they are large."""
    key = f"f_{kind}"
    every = Window.partitionBy(key)  # at most FOLDS rows
    sums = rows.groupBy(key, "f_fold").agg(F.count("*").alias("f_urls"), F.count("y").alias("f_n"), F.coalesce(F.sum("y"), F.lit(0)).alias("f_s"))
    sums = sums.select(key, "f_fold", F.sum("f_urls").over(every).alias("f_urls"), "f_n", "f_s", F.sum("f_n").over(every).alias("f_all_n"), F.sum("f_s").over(every).alias("f_all_s"))
    labelled = F.col("y").isNotNull()
    n, s = (F.col(f"f_all_{x}") - F.when(labelled, F.col(f"f_{x}")).otherwise(0) for x in "ns")
    hidden = (n == 0) | (labelled & (F.col("f_fold") == HIDDEN[kind]))
    known = {"share": F.round((s + PRIOR * mean) / (n + PRIOR), 3), "count": F.round(F.log2(F.col("f_urls") + 1.0), 2)}
    met = rows.join(sums, [key, "f_fold"]).withColumns({f"{key}_{name}": F.when(hidden, UNLABELLED).otherwise(c) for name, c in known.items()})
    return met.drop("f_urls", "f_n", "f_s", "f_all_n", "f_all_s", key)


def featured(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages (with host, path and `y`: 1 for blocked, 0 for not, null for unlabelled) and their features, f_*."""
    rows = pages.withColumns({f"f_{k}": v for k, v in features(url).items()}).withColumns({"f_tail": suffix(), "f_top": directory(), "f_fold": F.coalesce(F.pmod(F.xxhash64(url), F.lit(FOLDS)), F.lit(0)).cast("int")})
    mean = pages.agg(F.avg("y")).first()[0] or 0.0
    return _with_shares(_with_shares(rows, "tail", mean), "top", mean).drop("f_fold")


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees from featured() rows whose `y` is known."""
    labelled = rows.where("y is not null")
    n, mean = labelled.agg(F.count("*"), F.avg("y")).first()
    mean = float(mean or 0.0)
    base = math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    if not n or mean in (0.0, 1.0):
        return Trees([[] for _ in FEATURES], base)
    quantiles = labelled.agg(*(F.percentile(f"f_{x}", F.array(*(F.lit(i / BINS) for i in range(1, BINS)))) for x in FEATURES)).first()
    model = Trees([sorted(set(q)) for q in quantiles], base)
    names = [f"b{i}" for i in range(len(FEATURES))]
    binned = labelled.select("y", *(b.alias(x) for b, x in zip(model.bins(), names, strict=True)))
    binned = written(binned.groupBy("y", *names).count(), "urls")
    for tree in range(trees):
        shown = {(tree * SHOWN + i) % len(FEATURES) for i in range(SHOWN)}
        p = 1 / (1 + F.exp(-model.score()))
        scored = binned.withColumn("p", p).withColumns({"g": F.round((F.col("y") - F.col("p")) * F.col("count") * 1e6).cast("long"), "h": F.round(F.col("p") * (1 - F.col("p")) * F.col("count") * 1e6).cast("long")})
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        for level in range(depth):
            cells = scored.withColumn("node", Trees.node(splits)).where(F.col("node") >= 1 << level)
            cells = cells.select("node", "g", "h", F.posexplode(F.array(*names)).alias("feature", "bin")).where(F.col("feature").isin(sorted(shown))).groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h")).collect()
            sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for node, feature, bin_, g, h in cells:
                sums.setdefault(node, {}).setdefault(feature, {})[bin_] = (g / 1e6, h / 1e6)
            if not sums:
                break
            for node, by_feature in sums.items():
                whole = [sum(v[i] for v in next(iter(by_feature.values())).values()) for i in (0, 1)]
                worth = lambda g, h: g * g / (h + LAMBDA)
                found = []
                for feature, by_bin in sorted(by_feature.items()):
                    g = h = 0.0
                    for bin_ in sorted(by_bin)[:-1]:
                        g, h = g + by_bin[bin_][0], h + by_bin[bin_][1]
                        found.append((worth(g, h) + worth(whole[0] - g, whole[1] - h) - worth(*whole), -feature, -bin_, g, h))
                leaves[node] = RATE * whole[0] / (whole[1] + LAMBDA)
                if found and (best := max(found))[0] > 1e-6:
                    gain, feature, bin_, g, h = best
                    splits[node] = (-feature, -bin_)
                    leaves[2 * node] = RATE * g / (h + LAMBDA)
                    leaves[2 * node + 1] = RATE * (whole[0] - g) / (whole[1] - h + LAMBDA)
        if splits:
            model.trees.append((splits, leaves))
    return model


def classify(rows: DataFrame, model: Trees) -> DataFrame:
    """featured() rows with `block_score`, the trees' log-odds that the url is to be blocked."""
    return rows.withColumns({f"b{i}": b for i, b in enumerate(model.bins())}).withColumn("block_score", model.score())


def log_loss(scored: DataFrame) -> tuple[float, float]:
    """Of classify() rows with a label: the mean loss, and that of the labels' mean."""
    p = 1 / (1 + F.exp(-F.col("block_score")))
    loss, mean = scored.where("y is not null").agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))), F.avg("y")).first()
    return loss, -sum(x * math.log(x) for x in (mean, 1 - mean) if x)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score. labelled: url and y (1 for blocked); by default the urls the rules judge."""
    placed = pages.select("page_id", "url").withColumns({"host": host(), "path": path()})
    ruled = with_rules(placed, rules).withColumn("own", F.lit(True))
    if labelled is None:
        rows = ruled.withColumn("y", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("int")))
    else:
        known = labelled.select("url", F.col("y").cast("int").alias("y")).withColumns({"host": host(), "path": path()})
        rows = ruled.withColumn("y", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True)
    rows = written(featured(rows).drop("url"), "featured")
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return classify(rows.where("own"), fit(rows)).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
