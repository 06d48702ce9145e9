"""URL filters: gradient-boosted trees over lexical features, under explicit rules.

Labels are the rules' own verdicts, so the trees extend the rules to urls that
no rule fits.  Features: lengths, path depth, digit ratio, entropy, parameter
counts, and statistics of the host's suffixes, which are counted over all labelled
rows and joined.  The trees are fitted on the driver from the `max_labelled` distinct
labelled urls with the smallest hashes; scoring reads every row.

A null url or one without `://` has an empty host and path.  Repeated rows are
judged once each; without labelled urls every other verdict is "allow".  Urls of any length
are read whole; equal features give equal scores, and a score equal to the cut blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Rule = tuple[str, str, str]  # verdict, host, path
MAX_LABELLED = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path put together) and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def features(urls: list[str], hosts: list[str], paths: list[str], suffixes: np.ndarray) -> np.ndarray:
    """Feature matrix of urls; suffixes: four statistics of each url's host."""
    out = np.zeros((len(urls), 14))
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths)):
        rest = u.partition("?")[2].partition("#")[0]
        seen = np.unique(np.frombuffer(u.encode("utf-8", "replace") or b" ", np.uint8), return_counts=True)[1].astype(float)
        share = seen / seen.sum()
        steps = [x for x in p.split("/") if x]
        out[i, :10] = (
            len(u), len(h), len(p), len(steps), h.count("."), sum(c.isdigit() for c in u) / max(len(u), 1), -(share * np.log2(share)).sum(),
            rest.count("=") + 0.0, u.count("&"), len(steps[0]) if steps else 0,
        )
    out[:, 10:] = suffixes
    return out


class BoostedTrees:
    """Logistic gradient boosting with depth-limited histogram trees, in numpy."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.start, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y) or y.min() == y.max():
            self.start = -20.0 if not len(y) or y[0] == 0 else 20.0
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        xb = self._binned(x)
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(xb, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, xb)
        return self

    def _tree(self, xb: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes of a complete binary tree: (feature or -1, bin, value); children of i are 2i+1 and 2i+2."""
        nodes = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for i in range(len(nodes)):
            r = rows.pop(i, None)
            if r is None:
                continue
            gs, hs = g[r].sum(), h[r].sum()
            best = (1e-6, -1, 0)
            if 2 * i + 2 < len(nodes) and len(r) >= 2 * self.least:
                for j in range(xb.shape[1]):
                    b = xb[r, j]
                    n = np.cumsum(np.bincount(b, minlength=self.bins))[:-1]
                    gl, hl = np.cumsum(np.bincount(b, g[r], self.bins))[:-1], np.cumsum(np.bincount(b, h[r], self.bins))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(n < self.least) | (len(r) - n < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            nodes[i] = (best[1], best[2], float(-self.rate * gs / (hs + self.ridge)))
            if best[1] >= 0:
                left = xb[r, best[1]] <= best[2]
                rows[2 * i + 1], rows[2 * i + 2] = r[left], r[~left]
        return nodes

    def _walk(self, tree: list[tuple[int, int, float]], xb: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(x) for x in zip(*tree))
        at = np.zeros(len(xb), int)
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            at[go] = 2 * at[go] + 1 + (xb[go, f[go]] > cut[at[go]])
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        if self.trees:
            xb = self._binned(x)
            for t in self.trees:
                score += self._walk(t, xb)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _with_suffixes(rows: DataFrame, labelled: DataFrame, base: float) -> DataFrame:
    """rows with count (its logarithm) and smoothed blocked share of the last one and two labels of the host, over all labelled rows."""
    for level, parts in (("tld", -1), ("two", -2)):
        key = F.substring_index("host", ".", parts)
        counted = labelled.groupBy(key.alias("__key")).agg(F.count("*").alias("__n"), F.sum("blocked").alias("__b"))
        stats = counted.select("__key", F.log1p("__n").alias(f"{level}_n"), ((F.col("__b") + 5 * base) / (F.col("__n") + 5)).alias(f"{level}_b"))
        rows = rows.join(stats, key == F.col("__key"), "left").drop("__key")
        rows = rows.withColumns({f"{level}_n": F.coalesce(f"{level}_n", F.lit(0.0)), f"{level}_b": F.coalesce(f"{level}_b", F.lit(base))})
    return rows


def judge(pages: DataFrame, rules: list[Rule], max_labelled: int = MAX_LABELLED, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row of pages (page_id, url)."""
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "blocked": (verdict == "block").cast("double")})
    labelled = rows.where("ruled is not null")
    base = labelled.agg(F.avg("blocked")).first()[0] or 0.0
    rows = _with_suffixes(rows, labelled, base)
    names = ["tld_n", "tld_b", "two_n", "two_b"]
    sample = rows.where("ruled is not null").select("url", "host", "path", "blocked", *names).dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_labelled).toPandas()
    model = BoostedTrees().fit(features(list(sample["url"]), list(sample["host"]), list(sample["path"]), sample[names].to_numpy(float)), sample["blocked"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.probability(features(list(b["url"]), list(b["host"]), list(b["path"]), b[names].to_numpy(float)))
            own = np.where(p >= cut, "block", "allow")
            yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], "path": b["path"], "rule": b["rule"], "verdict": np.where(b["ruled"].isna(), own, b["ruled"]), "p_block": p})

    return rows.mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, p_block double")
