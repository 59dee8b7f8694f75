"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains, and the longest that fits wins.
URLs that no rule fits are judged by boosted trees on length, depth, digit ratio, entropy, parameter counts and suffix
statistics (how often URLs with this host ending, and with these host tokens, were labelled bad). The trees learn from
labelled URLs: those the rules decide, those in a table of labels, if one is given, and where neither says anything, those
with a token of a seed list as a whole token of their host. With a table of labels the others teach nothing; without one
they stand for good ones (positive-unlabelled learning), or else an ending that only a blocking rule mentions would look bad.
The statistics count all labelled URLs, each once, and are joined to the URLs by key; a URL's own label is left out of what
it is told. Only the rows that train the trees are a sample: at most `fit_urls`, taken by a hash of the URL and described by
the counts of the half of all URLs that they aren't in. They are trained on the driver and broadcast.

A null URL, or one without "://", has empty host and path and is judged like any other. Without URLs of both kinds to
learn from, every URL that no rule fits is allowed. Very long URLs are judged whole. Repeated rows are judged alike, and so
are URLs with equal features; a score at the threshold blocks; of several labels of a URL the worst counts, a null one says
nothing. Columns with clashing names keep them, the added ones take free names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import free, small_batches
from .line_dedup import CAPITALS, SMALL

#: Rules of the contract: fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host tokens that label a URL as bad where no rule decides; fixed values.
SEEDS = ("casino", "pills", "bets", "spam", "viagra", "porn", "lottery", "payday", "warez", "escort")
#: A key's share is drawn towards the overall share by so many URLs.
WEIGHT = 5.0
FEATURES = ("length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "query_length", "longest_token", "vowels", "suffix_bad", "token_bad", "path_bad", "has_extension")


def host_of(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end, A-Z lower-cased; empty without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(text)) if out is None else out.when(fits, F.lit(text))
    return out


def _tokens(host: str) -> list[str]:
    return [t for t in re.split(r"[.\-_]", host) if t]


@dataclass
class SuffixStatistics:
    """Share of bad among labelled URLs, for host endings, host tokens and first path parts; what is unknown gets the prior."""

    prior: float
    endings: dict[str, float]
    tokens: dict[str, float]
    paths: dict[str, float]

    @classmethod
    def of(cls, hosts: list[str], paths: list[str], bad: np.ndarray, weight: float = WEIGHT) -> SuffixStatistics:
        prior = float(bad.mean()) if len(bad) else 0.5

        def shares(keys: list[set[str]]) -> dict[str, float]:
            n, b = Counter(), Counter()
            for ks, y in zip(keys, bad):
                n.update(ks)
                if y:
                    b.update(ks)
            return {k: (b[k] + weight * prior) / (c + weight) for k, c in n.items()}

        return cls(prior, shares([cls.endings_of(h) for h in hosts]), shares([set(_tokens(h)) for h in hosts]), shares([{p.split("/")[1] if "/" in p else ""} for p in paths]))

    @staticmethod
    def endings_of(host: str) -> set[str]:
        parts = host.split(".")
        return {".".join(parts[-k:]) for k in (1, 2)}

    def look(self, host: str, path: str) -> tuple[float, float, float]:
        ends = [self.endings[e] for e in self.endings_of(host) if e in self.endings]
        toks = [self.tokens[t] for t in _tokens(host) if t in self.tokens]
        far = lambda x: max(x, key=lambda v: abs(v - self.prior), default=self.prior)
        return far(ends), max(toks, default=self.prior), self.paths.get(path.split("/")[1] if "/" in path else "", self.prior)


def lexical(url: str | None, host: str, path: str, shares: tuple[float, float, float]) -> list[float]:
    """The features of one URL, in the order of FEATURES; shares of bad by ending, token and path are given."""
    u = url or ""
    query = u.partition("?")[2].partition("#")[0]
    n = max(len(u), 1)
    p = np.array(list(Counter(u).values()), float) / n
    toks = _tokens(host)
    letters = sum(c.isalpha() for c in host)
    return [
        len(u), len(host), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in u) / n, host.count("-"), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        len([x for x in query.split("&") if x]), len(query), max(map(len, toks), default=0), sum(c in "aeiou" for c in host) / max(letters, 1),
        *shares, float(bool(re.search(r"\.[A-Za-z0-9]{1,5}$", path))),
    ]


@dataclass
class BoostedTrees:
    """Binary logistic boosting of depth-limited trees on binned features. Node k has children 2k+1 and 2k+2."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: float = 5.0) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, trees = np.full(len(y), start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            size = 2 ** (depth + 1) - 1
            feature, cut, value, node = np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(len(y), int)
            for k in range(size):
                rows = np.nonzero(node == k)[0]
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = rate * gs / (hs + smooth)
                if k >= 2**depth - 1 or len(rows) < 2 * least:
                    continue
                best = 1e-6
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.bincount(b[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(b[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
                    nl = np.bincount(b[rows, j], minlength=len(e) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], j, at
                if feature[k] >= 0:
                    node[rows] = np.where(b[rows, feature[k]] <= cut[k], 2 * k + 1, 2 * k + 2)
            f = f + value[node]
            trees.append((feature, cut, value))
        return cls(edges, start, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The likelihood of class 1."""
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                k = node[inner]
                node[inner] = np.where(b[rows[inner], feature[k]] <= cut[k], 2 * k + 1, 2 * k + 2)
            f += value[node]
        return 1 / (1 + np.exp(-f))


@dataclass
class UrlModel:
    stats: SuffixStatistics
    trees: BoostedTrees | None

    @classmethod
    def fit(cls, urls: list[str], hosts: list[str], paths: list[str], bad: list[int]) -> UrlModel:
        y = np.array(bad, float)
        # a URL's own label mustn't tell it its suffix statistics: each half of the rows is described by the other's
        half = np.arange(len(y)) % 2
        stats = SuffixStatistics.of(hosts, paths, y)
        if len(set(bad)) < 2:
            return cls(stats, None)
        pick = lambda z, k: [v for v, h in zip(z, half) if h == k]
        by = [SuffixStatistics.of(pick(hosts, k), pick(paths, k), y[half == k]) for k in (0, 1)]
        x = np.array([lexical(u, h, p, by[1 - k].look(h, p)) for u, h, p, k in zip(urls, hosts, paths, half)])
        return cls(stats, BoostedTrees.fit(x, y))

    def predict(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(urls))
        x = np.array([lexical(u, h, p, self.stats.look(h, p)) for u, h, p in zip(urls, hosts, paths)], float).reshape(-1, len(FEATURES))
        return self.trees.predict(x)


def keys_of(host: Column, path: Column) -> Column:
    """The (kind, key) pairs that are counted: the last one and two labels of the host, its tokens, the first part of the path."""
    parts = F.split(host, r"\.")
    endings = F.array(F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."))
    tokens = F.array_remove(F.split(host, r"[.\-_]"), "")
    firsts = F.array(F.coalesce(F.get(F.split(path, "/"), 1), F.lit("")))
    kind = lambda name, xs: F.transform(F.array_distinct(xs), lambda x: F.struct(F.lit(name).alias("kind"), x.alias("key")))
    return F.concat(kind("ending", endings), kind("token", tokens), kind("path", firsts))


def described(labelled: DataFrame) -> DataFrame:
    """labelled: (url, host, path, bad 0/1 or null) -> each URL once (null as the empty one) with counted (whether it is labelled
    and not null), the shares of bad of its ending, token and path over all other URLs, and train_*, the same over the half of them it isn't in."""
    some = labelled.withColumn("counted", (F.col("url").isNotNull() & F.col("bad").isNotNull()).cast("int")).withColumn("url", F.coalesce("url", F.lit(""))).withColumn("bad", F.coalesce("bad", F.lit(0)))
    urls = materialize(some.groupBy("url", "host", "path").agg(F.max("bad").alias("bad"), F.max("counted").alias("counted")).withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2))))
    half, bad, counted = F.col("half"), F.col("bad"), F.col("counted")
    counts = [F.sum(F.when(half == k, y).otherwise(0)).alias(f"{name}{k}") for k in (0, 1) for name, y in (("n", counted), ("b", bad * counted))]
    whole = urls.agg(*counts).first()
    mean = lambda n, b: (b or 0) / n if n else 0.5
    prior = [mean(whole[f"n{k}"], whole[f"b{k}"]) for k in (0, 1)]
    overall = mean((whole["n0"] or 0) + (whole["n1"] or 0), (whole["b0"] or 0) + (whole["b1"] or 0))
    pairs = urls.select("url", "bad", "counted", "half", F.explode(keys_of(F.col("host"), F.col("path"))).alias("k")).select("url", "bad", "counted", "half", "k.kind", "k.key")
    x = pairs.join(pairs.groupBy("kind", "key").agg(*counts), ["kind", "key"])
    other = lambda name: F.when(half == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    kinds = {"": (F.lit(overall), F.col("n0") + F.col("n1") - counted, F.col("b0") + F.col("b1") - bad * counted), "train_": (F.when(half == 0, prior[1]).otherwise(prior[0]), other("n"), other("b"))}
    told = []
    for name, (p, n, b) in kinds.items():
        share = F.when(n > 0, (b + WEIGHT * p) / (n + WEIGHT))
        of = lambda kind, v, share=share: F.max(F.when((F.col("kind") == kind) & share.isNotNull(), v))
        # of the endings the share farthest from the overall one, of the tokens the largest
        told += [F.coalesce(v, F.max(p)).alias(f"{name}{c}_bad") for c, v in (("ending", of("ending", F.struct(F.abs(share - p).alias("far"), share.alias("share")))["share"]), ("token", of("token", share)), ("path", of("path", share)))]
    return urls.drop("half").join(x.groupBy("url").agg(*told), "url")


def fit(urls: DataFrame, fit_urls: int = 20_000) -> BoostedTrees | None:
    """The trees, from rows of described(): those with the least hashes of their URL, fit_urls at most. None if all are of one kind."""
    rows = urls.where("counted = 1").orderBy(F.xxhash64("url"), "url").limit(fit_urls).collect()
    y = np.array([r["bad"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    return BoostedTrees.fit(np.array([lexical(r["url"], r["host"], r["path"], (r["train_ending_bad"], r["train_token_bad"], r["train_path_bad"])) for r in rows]), y)


def labelled_urls(x: DataFrame, rules=RULES, seeds=SEEDS, labels: DataFrame | None = None) -> DataFrame:
    """x: (url, host, path, rule). Each URL once: (url, host, path, bad 0/1, null for one that teaches nothing). labels: (url, bad 0/1)."""
    says = F.create_map(*(F.lit(v) for r in rules for v in r))
    seeded = F.arrays_overlap(F.split("host", r"[.\-_]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    urls = x.distinct()
    known = F.when(F.col("rule").isNotNull(), (says[F.col("rule")] == "block").cast("int"))
    if labels is not None:
        told = labels.where("url is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("label"))
        urls = urls.join(told, "url", "left")
        known = F.coalesce(known, "label", F.when(seeded, 1))
    else:
        known = F.coalesce(known, seeded.cast("int"))
    return urls.select("url", "host", "path", known.alias("bad"))


def judged(df: DataFrame, url: str = "url", rules=RULES, seeds=SEEDS, labels: DataFrame | None = None, fit_urls: int = 20_000, threshold: float = 0.5, model: UrlModel | None = None) -> DataFrame:
    """df with host, path, rule, bad_score (the trees', for every URL) and verdict. A model brings its own statistics."""
    small_batches(df.sparkSession, 2000)
    host, path, rule, score, verdict, key, told = free(df, "host", "path", "rule", "bad_score", "verdict", "u_key", "u_told")
    x = df.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url))).withColumn(rule, rule_of(F.col(host), F.col(path), rules))
    says = F.create_map(*(F.lit(v) for r in rules for v in r))
    if model is None:
        urls = materialize(described(labelled_urls(x.select(F.col(url).alias("url"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(rule).alias("rule")), rules, seeds, labels)))
        model = fit(urls, fit_urls)
        # every URL of x is among them
        x = x.withColumn(key, F.coalesce(F.col(url), F.lit(""))).join(urls.select(F.col("url").alias(key), F.array("ending_bad", "token_bad", "path_bad").alias(told)), key).select(*x.columns, told)
    else:
        x = x.withColumn(told, F.array().cast("array<double>"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def judge(urls: pa.Array, hosts: pa.Array, paths: pa.Array, told: pa.Array) -> pa.Array:
        m, us, hs, ps = shared.value, urls.to_pylist(), hosts.to_pylist(), paths.to_pylist()
        if isinstance(m, UrlModel):
            return pa.array(m.predict(us, hs, ps), pa.float64())
        if m is None:
            return pa.array(np.zeros(len(us)), pa.float64())
        rows = np.array([lexical(*row) for row in zip(us, hs, ps, told.to_pylist())], float).reshape(-1, len(FEATURES))
        return pa.array(m.predict(rows), pa.float64())

    x = x.withColumn(score, judge(F.col(url), F.col(host), F.col(path), F.col(told))).drop(told)
    return x.withColumn(verdict, F.when(F.col(rule).isNotNull(), says[F.col(rule)]).when(F.col(score) >= threshold, "block").otherwise("allow"))


def op10(pages: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "bad_score")
