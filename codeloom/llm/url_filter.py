"""URL filter: rules first, then gradient-boosted trees over lexical features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Labelled urls that training reads at most, in order of a hash of the url.
LABELLED = 20_000
FEATURES = ("length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digit_ratio", "host_hyphens", "host_entropy", "path_entropy", "parameters", "has_fragment", "suffix_rate", "segment_rate", "longest_label")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path from
    there up to ``? #`` or the end. Both are empty for a null or for a url without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return host.translate(LOWERED), path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class RuleBook:
    """Rules by their hosts: a url looks up its host and every domain above it, whatever the number of rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of several as long the first by its text."""
        best, at = None, 0
        while True:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path):
                    if best is None or (-len(rule.text), rule.text) < (-len(best.text), best.text):
                        best = rule
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


def labelled(pages: DataFrame, rules: Sequence[Rule], url: str = "url", bound: int = LABELLED, held_out: bool = False) -> tuple[list[str], list[int]]:
    """Urls of a table that ``rules`` decide, and 1 where they block: labels for the trees, which then judge the urls that
    no rule fits. At most ``bound`` distinct ones, in order of a hash, outside the fold of a fifth that is held out, or
    inside it. Null urls teach nothing."""
    book = RuleBook(rules)

    def decided(b: dict) -> dict:
        found = [(u, r.verdict) for u in b["url"] if (r := book.match(*split_url(u)))]
        return {"url": [u for u, _ in found], "blocked": [int(v == "block") for _, v in found]}

    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    urls = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull() & (fold if held_out else ~fold))
    rows = per_batch(urls, "url string, blocked int", decided).distinct().orderBy(F.xxhash64("url"), "url").limit(bound).toArrow()
    return rows["url"].to_pylist(), rows["blocked"].to_pylist()


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _digits(s: str) -> float:
    return sum(c.isdigit() for c in s) / len(s) if s else 0.0


def lexical(url: str | None, suffix_rates: dict[str, float]) -> list[float]:
    """The features of one url, in the order of FEATURES. ``suffix_rates`` holds the share of blocked urls by the host's
    suffix and, after a slash, by the path's first segment; what was never labelled has the rate under ''."""
    url = url or ""
    host, path, rest = re.match(r"(?s)(?:.*?://)?([^/?#]*)([^?#]*)(.*)", url).groups()
    host = host.lower()
    labels = host.split(".")
    segments = [p for p in path.split("/") if p]
    return [
        len(url), len(host), len(path), len(labels), len(segments), _digits(url), _digits(host), host.count("-"), _entropy(host), _entropy(path),
        len([p for p in rest.partition("#")[0].lstrip("?").split("&") if p]), float("#" in rest), suffix_rates.get(labels[-1], suffix_rates[""]), suffix_rates.get("/" + "".join(segments[:1]), suffix_rates[""]),
        max(map(len, labels)),
    ]


@dataclass
class Trees:
    """A boosted ensemble: per tree the split feature, threshold and leaf value of each node of a full binary tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    suffix_rates: dict[str, float]
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(urls: Sequence[str], blocked: Sequence[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, smoothing: float = 4.0) -> Trees:
    """Boosts depth-limited trees on the logistic loss with Newton leaf values; split points are feature quantiles."""
    y = np.asarray(blocked, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    seen: dict[str, list[float]] = {}
    for url, label in zip((u or "" for u in urls), y, strict=True):
        host, segment = re.match(r"(?s)(?:.*?://)?([^/?#]*)/*([^/?#]*)", url).groups()
        for key in (host.lower().split(".")[-1], "/" + segment):
            seen.setdefault(key, []).append(label)
    rates = {k: (sum(v) + smoothing * prior) / (len(v) + smoothing) for k, v in seen.items()} | {"": prior}
    x = np.array([lexical(u, rates) for u in urls], float).reshape(len(y), len(FEATURES))
    start, inner = math.log(prior / (1 - prior)), 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[:-1])) if len(y) else np.zeros(1) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1) if len(y) else np.zeros((0, len(cuts)), int)
    margin, made = np.full(len(y), start), []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for at in range(inner):
            rows, best = np.flatnonzero(node == at), 1e-9
            g, h = gradient[rows].sum(), hessian[rows].sum()
            for k, c in enumerate(cuts):
                gs = np.bincount(binned[rows, k], gradient[rows], len(c) + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, k], hessian[rows], len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                if len(gain) and gain.max() > best:
                    best, feature[at], threshold[at] = gain.max(), k, c[gain.argmax()]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        margin += value[leaf]
        made.append((feature, threshold, value))
    stack = lambda k, width, kind: np.array([m[k] for m in made], kind).reshape(-1, width)
    return Trees(stack(0, inner, int), stack(1, inner, float), stack(2, inner + 1, float), start, rates, depth)


def sample_labels(n: int = 4000, seed: int = 7) -> tuple[list[str], list[int]]:
    """Labelled urls made from a rule, for when no list of one's own is at hand. Blocked ones show what link farms do:
    hyphenated or digit-laden hosts, tracking parameters in numbers, deep or random paths."""
    rng = np.random.default_rng(seed)
    pick = lambda a: a[rng.integers(len(a))]
    word = lambda k=3: "".join(pick("bcdfghlmnprstvw") + pick("aeiou") for _ in range(k))
    urls, labels = [], []
    for i in range(n):
        bad, form = i % 2, rng.integers(4)
        sub, tld = pick(["", "", "www.", "blog.", "m."]), pick(["com", "net", "org"])
        tail = pick(["", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"])
        host, path = f"{sub}{word(rng.integers(2, 5))}.example.{tld}", f"/{pick(['en', 'de', 'fr', 'es'])}/{rng.integers(1, 60000)}"
        if bad and form == 3:
            host, tail = f"{sub}{word(2)}{rng.integers(10, 10**6)}.example.{tld}", "?" + "&".join(f"{word(1)}={rng.integers(10**6)}" for _ in range(rng.integers(4, 9)))
        elif bad:
            host = f"{sub}{word(rng.integers(1, 4))}-{word(rng.integers(1, 4))}.example.{tld}"
            path = path if form else "/" + "/".join(word(rng.integers(1, 3)) for _ in range(rng.integers(5, 10)))
        urls.append(f"{pick(['http', 'https'])}://{host}{path}{tail}")
        labels.append(int(bad))
    return urls, labels


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: Trees, threshold: float = 0.5, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of ``pages``.

    The longest fitting rule decides; without one, ``block`` if the trees give ``threshold`` or more. A null or empty
    url has an empty host and path, fits no rule, and is judged by the trees as an empty url. Repeated rows are judged
    each; other columns, also of these names, are ignored; an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast((RuleBook(rules), model))

    def judge(b: dict) -> dict:
        book, trees = shared.value
        parts = [split_url(u) for u in b["url"]]
        found = [book.match(*p) for p in parts]
        score = trees.score(np.array([lexical(u, trees.suffix_rates) for u in b["url"]], float).reshape(-1, len(FEATURES)))
        verdict = [r.verdict if r else "block" if s >= threshold else "allow" for r, s in zip(found, score, strict=True)]
        return {key: b["key"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r and r.text for r in found], "verdict": verdict, "score": score}

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    return per_batch(rows, f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string, score double", judge)
