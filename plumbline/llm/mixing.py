"""Mixing sources to target weights: soft membership.

A multinomial classifier trained on a labelled table gives each document posteriors over
the domains. Nonnegative document rates are then fitted so that the expected token total
of each domain, the sum of rate * tokens * posterior, matches its target share of the
budget: accelerated projected gradient on the least-squares error, in the metric that
weighs a document by its tokens, with residuals scaled by the inverse of the domains'
moment matrix. A rate depends only on the document's posteriors and on the residuals so
far, one short vector an iteration, so no state is kept for documents: an iteration is
one pass that sums a vector for each partition, and a lost executor costs a recomputation
of its partitions only. The partitions' sums are added as decimals, so the order in which
they come changes nothing. Features of the labelled texts are made in tasks; the driver
gets TRAIN_ROWS vectors of fixed size a domain, never a text.

Rates have no upper bound unless one is given. Targets that no nonnegative rates reach
(a domain that no document belongs to) get the nearest shares by plain least squares and
a warning that states them; `Rates.shares` and `Rates.met` have them in every case.

Null and empty texts have no tokens and uniform posteriors; they get a rate like any
other row. Rows with equal texts get equal rates; their numbers of copies differ only by
the hash of doc_id (null hashes like a value) that rounds the rate. With no labelled rows
the posteriors are uniform. Ties in the choice of labelled rows are broken by doc_id. Very
long texts are read whole. An empty table gives an empty result. Columns besides doc_id and
text play no part; `resample` returns all columns unchanged, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import packing
from plumbline.llm.common import LOWER, map_rows, to_arrow
from plumbline.session import cut

#: Target shares of the token budget.
TARGETS = {"de": 0.15, "en": 0.55, "es": 0.12, "fr": 0.18}
#: Bound of the labelled sample, for each domain.
TRAIN_ROWS = 800
BUCKETS = 4096
TOLERANCE = 1e-6
#: Passes before the first look at progress; later looks are at each doubling.
FIRST_LOOK = 50
#: Bound of the text in one batch of repeated rows, in characters.
PIECE = 1 << 24
SCHEMA = "doc_id long, n_tokens long, posteriors array<double>, rate double, copies int"
MEMBERS = "doc_id long, n_tokens long, posteriors array<double>"


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs."""
    raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int64)
    if len(raw) < 2:
        return np.zeros(BUCKETS, np.float32)
    counts = np.bincount((raw[:-1] * 251 + raw[1:] * 17) % BUCKETS, minlength=BUCKETS)
    return np.sqrt(counts / (len(raw) - 1)).astype(np.float32)


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # (buckets + 1, domains), the last row is the bias

    def posteriors(self, text: str | None) -> np.ndarray:
        x = text_features(text)
        if not x.any():
            return np.full(len(self.domains), 1 / len(self.domains))
        z = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_classifier(x: np.ndarray, labels: list[str], domains: list[str], rounds: int = 300, ridge: float = 1e-5) -> Classifier:
    """Softmax regression by full-batch gradient descent with momentum; classes weigh alike."""
    weights = np.zeros((BUCKETS + 1, len(domains)), np.float32)
    if not len(x):
        return Classifier(domains, weights)
    y = np.array([domains.index(v) for v in labels])
    hot = np.eye(len(domains), dtype=np.float32)[y]
    share = (1 / np.bincount(y, minlength=len(domains)).clip(1))[y][:, None].astype(np.float32) / len(domains)
    step, speed = 8.0, np.zeros_like(weights)
    for _ in range(rounds):
        z = x @ weights[:-1] + weights[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        g = share * (e / e.sum(1, keepdims=True) - hot)
        speed = 0.9 * speed - step * 0.1 * np.vstack([x.T @ g + ridge * weights[:-1], g.sum(0, keepdims=True)])
        weights += speed
    return Classifier(domains, weights)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Classifier:
    """From `docs` (doc_id, text) and `labelled` (doc_id, domain): at most TRAIN_ROWS whole texts a domain, by hash of doc_id.

    A doc_id with two domains isn't learned from; of several texts under one doc_id the smallest is.
    """
    sides = labelled.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("_other"))
    ids = sides.where("domain = _other").drop("_other")
    chosen = None
    for d in domains:
        part = ids.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))  # TRAIN_ROWS ids a domain

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "domain": batch["domain"], "x": [text_features(t).astype(np.float16).tobytes() for t in batch["text"]]}

    got = sorted(tuple(r) for r in map_rows(rows.select("doc_id", "domain", "text"), run, "doc_id long, domain string, x binary").collect())
    x = np.array([np.frombuffer(v, np.float16) for _, _, v in got], np.float32).reshape(len(got), BUCKETS)
    return fit_classifier(x, [d for _, d, _ in got], domains)


def n_tokens(text: str | None, vocabulary: str, ranks: str) -> int:
    return len(packing.encode(text, vocabulary, ranks)) if text else 0


def membership(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posteriors) of each row of `docs` (doc_id, text)."""
    import public_tokenizers

    vocabulary, ranks = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": [n_tokens(t, vocabulary, ranks) for t in batch["text"]],
            "posteriors": [model.posteriors(t).tolist() for t in batch["text"]],
        }

    return map_rows(docs.select("doc_id", "text"), run, MEMBERS)


@dataclass
class Rates:
    """Document rates as a function of posteriors: a start and the residuals of the steps taken."""

    start: float
    step: float
    cap: float
    residuals: list[np.ndarray] = field(default_factory=list)
    shares: dict[str, float] = field(default_factory=dict)  # expected tokens of each domain by the budget
    met: bool = False

    def of(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates of the rows of `p`; `ahead` gives the point at which the next gradient is taken."""
        return self.both(p)[int(ahead)]

    def both(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = y = np.full(len(p), self.start)
        t = 1.0
        for r in self.residuals:
            new = np.clip(y - self.step * (p @ r), 0.0, self.cap)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
        return x, y


def sums(members: DataFrame, rates: Rates, size: int, moments: bool = False) -> np.ndarray:
    """Sums of tokens * rate * posteriors for the rates and those ahead, or of tokens * outer products and tokens; one vector a partition, added by Spark."""
    width = size * size + 1 if moments else 2 * size

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                if moments:
                    total += np.append((p * t[:, None]).T @ p, t.sum())
                else:
                    total += np.concatenate([(t * x) @ p for x in rates.both(p)])
        yield pa.RecordBatch.from_pydict({"k": list(range(width)), "v": total.tolist()})

    # A sum of doubles depends on the order in which partitions come, a sum of decimals doesn't.
    exact = members.select("n_tokens", "posteriors").mapInArrow(run, "k long, v double").select("k", F.col("v").cast("decimal(38,12)").alias("v"))
    out = np.zeros(width)
    for r in exact.groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = float(r["v"])
    return out


def descend(members: DataFrame, rates: Rates, share: np.ndarray, budget: float, scale: np.ndarray) -> np.ndarray:
    """Adds scaled residuals to `rates` until each share is within TOLERANCE of its target, or doubled passes don't halve the error; the shares reached."""
    best, before, look = np.inf, np.inf, FIRST_LOOK
    while True:
        got, ahead = sums(members, rates, len(share)).reshape(2, -1) / budget
        best = min(best, max(0.0, float((got - share) @ scale @ (got - share))))
        if np.abs(got - share).max() < TOLERANCE:
            return got
        if len(rates.residuals) == look:
            if best >= before / 2 < np.inf:
                return got
            before, look = best, 2 * look
        rates.residuals.append(scale @ (ahead - share))


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, cap: float = np.inf) -> Rates:
    """Projected gradient until each domain's expected share is within TOLERANCE of its target; warns where that can't be reached.

    `budget` is in tokens; without one it is the number of tokens there are.
    """
    domains = sorted(targets)
    size = len(domains)
    share = np.array([targets[d] for d in domains], float)
    share = share / share.sum()
    moments = sums(members, Rates(1.0, 0.0, cap), size, moments=True)
    tokens = moments[-1]
    budget = float(tokens if budget is None else budget)
    if tokens <= 0 or budget <= 0:
        return Rates(0.0 if budget <= 0 else 1.0, 0.0, cap, shares=dict.fromkeys(domains, 0.0), met=budget <= 0)
    moment = moments[:-1].reshape(size, size) / budget
    start = min(cap, budget / tokens)
    # In this scale the error's curvature is 1; without an active bound the first step is exact.
    rates = Rates(start, 1.0, cap)
    got = descend(members, rates, share, budget, np.linalg.pinv(moment, rcond=1e-12, hermitian=True))
    if not np.abs(got - share).max() < TOLERANCE:
        # Out of reach: the scale would let the rarest domain outweigh the others, so least squares of the plain shares.
        rates = Rates(start, 1.0, cap)
        got = descend(members, rates, share, budget, np.eye(size) / max(float(np.linalg.eigvalsh(moment)[-1]), 1e-12))
    rates.shares, rates.met = dict(zip(domains, got.tolist(), strict=True)), bool(np.abs(got - share).max() < TOLERANCE)
    if not rates.met:
        warnings.warn(f"mixing targets not met: reached {rates.shares}, wanted {dict(zip(domains, share.tolist(), strict=True))}", stacklevel=2)
    return rates


def copies(doc_ids: list, rates: np.ndarray) -> list[int]:
    """Rates rounded by the hash of doc_id, so that the expected number of copies is the rate."""
    return [int(r) + int(xxhash.xxh64_intdigest(str(d)) / 2**64 < r - int(r)) for d, r in zip(doc_ids, rates.tolist(), strict=True)]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, cap: float = np.inf) -> DataFrame:
    """One row per row of `docs`: tokens, posteriors (domains in sorted order), rate and copies."""
    targets = targets or TARGETS
    members = cut(membership(docs, train(docs, labelled, sorted(targets))))
    rates = fit_rates(members, targets, budget, cap)

    def run(batch: dict[str, list]) -> dict[str, list]:
        x = rates.of(np.array(batch["posteriors"], float))
        return dict(batch) | {"rate": x.tolist(), "copies": copies(batch["doc_id"], x)}

    return map_rows(members, run, SCHEMA)


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, cap: float = np.inf) -> DataFrame:
    """The rows of `docs`, each as often as its rate says, all columns unchanged."""
    targets = targets or TARGETS
    model = train(docs, labelled, sorted(targets))
    rates = fit_rates(cut(membership(docs, model)), targets, budget, cap)
    arrow = to_arrow(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(arrow.get_field_index(c)).to_pylist() for c in ("doc_id", "text")]
                x = rates.of(np.stack([model.posteriors(t) for t in columns[1]]))
                ends = np.cumsum(copies(columns[0], x))
                rows = max(1, PIECE // max(1, *(len(t or "") for t in columns[1])))
                for at in range(0, int(ends[-1]), rows):  # a rate has no bound, a batch has
                    yield batch.take(pa.array(np.searchsorted(ends, np.arange(at, min(at + rows, int(ends[-1]))), side="right")))

    return docs.mapInArrow(run, docs.schema)


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query: documents of good quality in `labels`, by language (doc_id, domain)."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")
