"""URL filters: gradient-boosted trees on lexical features, under rules that win.

Features: lengths, depth, digit share, character entropy, parameter counts, hyphens,
subdomains, and the statistics of the host's suffix and path's extension in the labelled
URLs. Rules (host, path prefix) are looked up first; the longest that fits decides, and
where none does the trees' verdict holds.

A null URL and one without `://` have empty host and path; the trees judge the raw text.
Of rules that fit and are equally long the one with the longer host wins. Repeated rows are
judged alike, very long URLs whole. An empty table gives an empty result; other columns play
no part, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import boost
from plumbline.llm.common import map_rows

SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"
#: (host, path) -> verdict.
RULES = {
    ("com", "/"): "allow",
    ("example.com", "/en/"): "block",
    ("www.example.com", "/en/"): "allow",
    ("net", "/es/"): "block",
    ("net", "/fr/"): "block",
}
BLOCK_FROM = 0.5
#: Bound of the labelled sample.
TRAIN_URLS = 4000
SMOOTH = 5.0
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(LOWER), path


class Rules:
    """Rules by host, and each host's paths by length: a URL costs a look-up for each of its host's suffixes that can have a rule."""

    def __init__(self, rules: dict[tuple[str, str], str]) -> None:
        self.verdicts = rules
        self.longest = max((len(h) for h, _ in rules), default=0)
        self.paths: dict[str, set[str]] = defaultdict(set)
        for h, p in rules:
            self.paths[h].add(p)
        self.lengths = {h: sorted({len(p) for p in ps}, reverse=True) for h, ps in self.paths.items()}

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule whose host is the URL's or above it and whose path starts the URL's."""
        best, size = None, -1
        at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1
        while host and (at or len(host) <= self.longest):
            own = host[at:]
            for n in self.lengths.get(own, ()):
                if len(own) + n <= size or n > len(path):
                    continue
                if path[:n] in self.paths[own]:
                    best, size = (own, path[:n]), len(own) + n
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix(host: str) -> str:
    return ".".join(host.rsplit(".", 2)[-2:])


def extension(path: str) -> str:
    return m[1] if (m := re.search(r"\.([A-Za-z0-9]{1,5})$", path)) else ""


@dataclass
class Filter:
    model: boost.Boosted
    suffixes: dict[str, float]
    tails: dict[str, float]
    extensions: dict[str, float]
    prior: float

    def features(self, url: str | None) -> list[float]:
        url = url or ""
        host, path = split(url)
        query = url.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in url)
        labels = host.split(".")
        name = max(labels[:-1] or labels, key=len)
        return [
            len(url), len(host), len(path), path.count("/"), len(labels), digits / max(1, len(url)),
            sum(c.isdigit() for c in host), host.count("-"), path.count("-"), entropy(host), entropy(path), len(name),
            len([p for p in query.split("&") if p]), len(query), float("#" in url), float(url.startswith("https://")),
            sum(c in "%_~@" for c in url), self.suffixes.get(suffix(host), self.prior),
            self.tails.get(labels[-1], self.prior), self.extensions.get(extension(path), self.prior),
        ]

    def scores(self, urls: Sequence[str | None]) -> np.ndarray:
        return self.model.proba(np.array([self.features(u) for u in urls], float)) if len(urls) else np.empty(0)


def rates(keys: list[str], labels: Sequence[int], prior: float) -> dict[str, float]:
    """Smoothed share of blocked URLs by key."""
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for k, y in zip(keys, labels, strict=True):
        seen[k][0] += y
        seen[k][1] += 1
    return {k: (b + SMOOTH * prior) / (n + SMOOTH) for k, (b, n) in seen.items()}


def train(urls: Sequence[str], labels: Sequence[int], seed: int = 7) -> Filter:
    """Fit on labelled URLs (1: block). Each half gets its suffix statistics from the other, so they aren't memorised."""
    prior = float(np.mean(labels))
    half = np.random.default_rng(seed).integers(0, 2, len(urls))
    rows, targets = [], []
    hosts = [split(u) for u in urls]
    keys = [[suffix(h) for h, _ in hosts], [h.rsplit(".", 1)[-1] for h, _ in hosts], [extension(p) for _, p in hosts]]
    for side in (0, 1):
        own = [k for k in range(len(urls)) if half[k] == side]
        other = [k for k in range(len(urls)) if half[k] != side]
        part = Filter(boost.Boosted(0.0), *(rates([col[k] for k in other], [labels[k] for k in other], prior) for col in keys), prior)
        rows += [part.features(urls[k]) for k in own]
        targets += [labels[k] for k in own]
    model = boost.train(np.array(rows), np.array(targets))
    return Filter(model, *(rates(col, labels, prior) for col in keys), prior)


def seed_urls(n: int = 2000, seed: int = 11) -> tuple[list[str], list[int]]:
    """Labelled URLs made by rule: plain site paths, and the lexical habits of link farms."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "an ther in on re th st ed er ing nd tion ha es ly ou wh".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(2, 4))))
    bait = "cheap free win best pills casino deals spam farm bonus loan click buy seo".split()
    urls, labels = [], []
    for k in range(n):
        bad = k % 2
        scheme = "https" if rng.random() < (0.3 if bad else 0.6) else "http"
        if bad:
            name = "-".join(pick(bait) if rng.random() < 0.7 else word() for _ in range(int(rng.integers(2, 5))))
            name += str(int(rng.integers(1, 9999))) if rng.random() < 0.3 else ""
        else:
            name = word()
        host = pick(["", "www.", "blog.", "m."]) + name + "." + pick(["example.com", "example.net", "example.org", "example.com", "example.org"])
        path = f"/{pick(['en', 'fr', 'de', 'es'])}/{int(rng.integers(1, 999))}" + pick(["", "/", ".html"])
        if bad and rng.random() < 0.4:
            path += "/" + "-".join(pick(bait) for _ in range(3)) + str(int(rng.integers(1e6)))
        if not bad and rng.random() < 0.3:
            path = "/" + "/".join(word() for _ in range(int(rng.integers(1, 4))))
        query = pick(["", "", "#top", "?utm_source=feed", "?page=2&ref=x"])
        if bad and rng.random() < 0.4:
            query = "?" + "&".join(f"{word()}={int(rng.integers(1e7))}" for _ in range(int(rng.integers(2, 7))))
        urls.append(f"{scheme}://{host}{path}{query}")
        labels.append(bad)
    return urls, labels


@functools.cache
def default_filter() -> Filter:
    return train(*seed_urls())


def labelled(rows: DataFrame, url: str = "url", label: str = "label") -> Filter:
    """Train on at most TRAIN_URLS labelled rows, taken by hash of the URL."""
    got = rows.where(F.col(label).isin(0, 1) & F.col(url).isNotNull()).orderBy(F.xxhash64(url), url).limit(TRAIN_URLS).select(url, label).collect()
    return train([r[0] for r in got], [int(r[1]) for r in got])


def judge(pages: DataFrame, rules: dict[tuple[str, str], str] | None = None, model: Filter | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url)."""
    index = Rules(RULES if rules is None else rules)
    model = model or default_filter()

    def run(batch: dict[str, list]) -> dict[str, list]:
        parts = [split(u) for u in batch["url"]]
        scores = model.scores(batch["url"])
        fits = [index.of(h, p) for h, p in parts]
        return {
            "page_id": batch["page_id"], "host": [h for h, _ in parts], "path": [p for _, p in parts],
            "rule": ["".join(f) if f else None for f in fits],
            "verdict": [index.verdicts[f] if f else "block" if s >= BLOCK_FROM else "allow" for f, s in zip(fits, scores, strict=True)],
            "score": [float(s) for s in scores],
        }

    return map_rows(pages.select("page_id", "url"), run, SCHEMA)
