"""Toxicity: a weighted finite-state grammar over clauses.

Five letter-to-letter transducers are composed into one. Each has numbered states and
weighted arcs, and each rewrites the symbols of the one before:

    negation    an insult or menace within REACH words after a negation becomes a negated one
    reported    an insult after a reporting verb, or in a clause that a reporting clause
                opens with a colon, becomes a reported one
    target      an insult or menace near a target becomes a targeted one; a target that is
                still to come is promised, and a path that doesn't keep its promise dies
    threat      a menace after an intent or with a target becomes a threat, others vanish
    insult      an insult counts in a clause that has other words; one that stands alone
                as a whole clause vanishes

A lexical reading comes first: each word gives its symbols with weights, INSULT for stems
learned from labelled rows (weight: log odds), closed classes for the rest. The best path
through the composed machine says what a clause means and what it weighs; the weights of
accepted clauses are summed by kind, and the kinds' part in the score is fitted on the
labelled rows. The corpus's labels are put on texts whose insults mostly have no target,
so an insult without one is accepted too, as the plain kind.

Stems are learned by Spark from at most TRAIN_ROWS labelled texts a label, none of which
is collected. A stem's log odds must reach MIN_LOG_ODDS and the log likelihood ratio of
its texts MIN_EVIDENCE, the same bounds at every size. Each toxic text stands for one
left neighbour of the stem, and only different ones count as evidence, so copies of one
text vote once.

Null, empty and clean texts accept no path and get the lowest score. Texts are never cut,
and repeated rows score alike. Paths of equal weight are told apart by state number. With
no labelled rows of both labels every score is PRIOR. An empty table gives an empty
result. Columns besides doc_id and text play no part in scores; `keep` returns all columns
unchanged, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import filter_rows, held_out, map_rows, to_arrow
from plumbline.session import cut

#: Bound of the labelled sample, for each label.
TRAIN_ROWS = 3000
THRESHOLD = 0.7
PRIOR = 0.05
#: Least share of the toxic texts that a stem is in; bounds of its log odds and of their log likelihood ratio.
MIN_SHARE = 0.01
MIN_LOG_ODDS = 4.5
MIN_EVIDENCE = 10.0
STEM_LENGTHS = (4, 5, 6, 7, 8)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_clauses int, n_matched int, kinds array<double>"
STEMS = "cand string, whole boolean, label int, left long"

# Fixed closed classes.
TARGETS = frozenset("you your he him she her they them these those we us du dich ihr sie er euch tu te toi vous ils elles tú ti vosotros ustedes ellos".split())
NEGATIONS = frozenset("not no never nor neither isn't aren't wasn't don't cannot kein keine nie niemals jamais non nunca jamás".split())
REPORTS = frozenset("said says say called calls wrote reported quoted claims claimed sagte schrieb nannte dit écrit dijo escribió llamó".split())
MENACES = frozenset("kill hurt destroy attack beat hunt burn shoot stab töten umbringen tuer frapper matar golpear".split())
INTENTS = frozenset("will shall going gonna must werde werden vais allons voy vamos".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
KINDS = ("insult", "targeted insult", "negated insult", "reported insult", "threat", "negated threat")
#: Arc weights by kind: what an accepted clause weighs besides its words.
WEIGHTS = (4.0, 5.0, 1.0, 1.0, 3.0, 0.5)
REACH = 3  # words over which a negation, an intent or a target acts

# Symbols: what the lexical reading writes, then what the transducers rewrite them to.
OTHER, INSULT, TARGET, NEGATION, REPORT, INTENT, MENACE = range(7)
NEGATED, REPORTED, TARGETED, NEGATED_MENACE, AIMED, NEGATED_AIMED, THREAT, NEGATED_THREAT = range(7, 15)
KIND_OF = {INSULT: 0, TARGETED: 1, NEGATED: 2, REPORTED: 3, THREAT: 4, NEGATED_THREAT: 5}
SYMBOLS = range(15)
Arc = tuple[int, float, int]  # output, weight, next state


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and input symbol; state 0 is the start, `final` holds the states that accept."""

    arcs: tuple[dict[int, tuple[Arc, ...]], ...]
    final: frozenset[int]


def machine(start: object, step: Callable[[object, int], Iterable[tuple[int, float, object]]], accepts: Callable[[object], bool]) -> Transducer:
    """Number the states that `step` reaches from `start`."""
    numbers, order, arcs = {start: 0}, [start], []
    for state in order:  # grows while it runs
        own: dict[int, tuple[Arc, ...]] = {}
        for symbol in SYMBOLS:
            out = []
            for written, weight, to in step(state, symbol):
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                out.append((written, weight, numbers[to]))
            if out:
                own[symbol] = tuple(out)
        arcs.append(own)
    return Transducer(tuple(arcs), frozenset(n for state, n in numbers.items() if accepts(state)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads what `first` reads and writes what `second` makes of its output; weights add."""

    def step(state: tuple[int, int], symbol: int) -> Iterator[tuple[int, float, tuple[int, int]]]:
        for middle, w, p in first.arcs[state[0]].get(symbol, ()):
            for written, v, q in second.arcs[state[1]].get(middle, ()):
                yield written, w + v, (p, q)

    return machine((0, 0), step, lambda s: s[0] in first.final and s[1] in second.final)


def negation() -> Transducer:
    """State: words for which the last negation still acts."""

    def step(left: int, symbol: int) -> list[tuple[int, float, int]]:
        if symbol == NEGATION:
            return [(symbol, 0.0, REACH)]
        written = {INSULT: NEGATED, MENACE: NEGATED_MENACE}.get(symbol, symbol) if left else symbol
        return [(written, 0.0, max(0, left - 1))]

    return machine(0, step, lambda s: True)


def reported() -> Transducer:
    """State: has a reporting verb been read?"""

    def step(inside: bool, symbol: int) -> list[tuple[int, float, bool]]:
        return [(REPORTED if inside and symbol == INSULT else symbol, 0.0, inside or symbol == REPORT)]

    return machine(False, step, lambda s: True)


def target() -> Transducer:
    """State: words for which the last target still acts, and words within which a promised one must come (0: none is due)."""

    def step(state: tuple[int, int], symbol: int) -> list[tuple[int, float, tuple[int, int]]]:
        left, due = state
        if symbol == TARGET:
            return [(symbol, 0.0, (REACH, 0))]
        if due == 1:
            return []
        now, later = (max(0, left - 1), max(0, due - 1)), (max(0, left - 1), due - 1 if due else REACH)
        if symbol == INSULT:
            return [(TARGETED, 0.0, now)] if left else [(INSULT, 0.0, now), (TARGETED, 0.0, later)]
        if symbol in (MENACE, NEGATED_MENACE):
            return [(symbol, 0.0, now), (AIMED if symbol == MENACE else NEGATED_AIMED, 0.0, later)]
        return [(symbol, 0.0, now)]

    # A target in the last REACH words keeps a promise: `due` is REACH right after an insult.
    return machine((0, 0), step, lambda s: s[1] == 0)


def threat() -> Transducer:
    """State: words for which the last intent still acts."""

    def step(left: int, symbol: int) -> list[tuple[int, float, int]]:
        to = REACH if symbol == INTENT else max(0, left - 1)
        if symbol in (AIMED, NEGATED_AIMED):
            return [(THREAT if symbol == AIMED else NEGATED_THREAT, 0.0, to)]
        if symbol in (MENACE, NEGATED_MENACE):
            return [((THREAT if symbol == MENACE else NEGATED_THREAT) if left else OTHER, 0.0, to)]
        return [(symbol, 0.0, to)]

    return machine(0, step, lambda s: True)


def insult() -> Transducer:
    """State: nothing read, one plain insult and nothing else, or a clause with other words. The arcs of kinds carry their weights."""

    def step(state: str, symbol: int) -> list[tuple[int, float, str]]:
        weight = WEIGHTS[KIND_OF[symbol]] if symbol in KIND_OF else 0.0
        if state == "empty" and symbol == INSULT:
            return [(symbol, weight, "alone"), (OTHER, 0.0, "clause")]
        return [(symbol, weight, "clause")]

    return machine("empty", step, lambda s: s != "alone")


@functools.cache
def grammar_machine() -> Transducer:
    return functools.reduce(compose, (negation(), reported(), target(), threat(), insult()))


def best_path(fst: Transducer, readings: Sequence[Sequence[tuple[int, float]]]) -> tuple[float, list[tuple[int, float]]]:
    """Weight of the best accepted path, and the (output, lexical weight) of each of its arcs that writes a kind.

    A word gives one reading (symbol, weight) or several; a path takes one of each word.
    """
    active: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in readings:
        ahead: dict[int, tuple[float, tuple | None]] = {}
        for state, (total, path) in active.items():
            arcs = fst.arcs[state]
            for symbol, own in options:
                for written, weight, to in arcs.get(symbol, ()):
                    new = total + own + weight
                    if to not in ahead or new > ahead[to][0]:
                        ahead[to] = (new, (path, written, own) if written in KIND_OF else path)
        active = ahead
    done = [(total, -state, path) for state, (total, path) in active.items() if state in fst.final]
    if not done:
        return -math.inf, []
    total, _, path = max(done, key=lambda d: d[:2])
    out = []
    while path:
        out.append((path[1], path[2]))
        path = path[0]
    return total, out[::-1]


@dataclass(frozen=True)
class Grammar:
    """Learned stems with log odds, and the part of each kind in the score."""

    stems: dict[str, float]
    whole: frozenset[str]
    weights: tuple[float, ...]
    bias: float


def candidates(word: str) -> list[tuple[str, bool]]:
    """What the lexical reading may learn from a word: itself and its stems."""
    return [(word, True), *((word[:n], False) for n in STEM_LENGTHS if len(word) >= n)]


def stem_rows(text: str | None) -> dict[tuple[str, bool], int]:
    """Candidates of one text, each with the least hash of the words left of it: copies of a text have the same."""
    found: dict[tuple[str, bool], int] = {}
    words = WORD.findall((text or "").lower())
    for left, word in zip(["", *words], words, strict=False):
        if word not in TARGETS and word not in NEGATIONS and word not in REPORTS:
            mark = xxhash.xxh64_intdigest(left) >> 1
            for c in candidates(word):
                found[c] = min(mark, found.get(c, mark))
    return found


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Smoothed log odds of the class rates."""
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log likelihood ratio of a stem's texts against the labels' own shares."""
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    return toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)


def choose(seen: Iterable[tuple[str, bool, int, int, int]], all_toxic: int, all_clean: int) -> tuple[dict[str, float], frozenset[str]]:
    """Stems and whole words that mark label 1, from (candidate, whole, toxic texts, clean texts, contexts in toxic texts)."""
    odds = {}
    for cand, whole, toxic, clean, contexts in seen:
        if toxic and toxic >= MIN_SHARE * all_toxic:
            w = log_odds(toxic, clean, all_toxic, all_clean)
            if w >= MIN_LOG_ODDS and evidence(min(toxic, contexts), clean, all_toxic, all_clean) >= MIN_EVIDENCE:
                odds[cand, whole] = w
    # A word or longer stem adds nothing where a shorter stem already marks it.
    stems = {s: w for (s, whole), w in odds.items() if not whole and not any((s[:n], False) in odds for n in STEM_LENGTHS if n < len(s))}
    words = {s: w for (s, whole), w in odds.items() if whole and not any(s[:n] in stems for n in STEM_LENGTHS if n <= len(s))}
    return stems | words, frozenset(words)


def lexer(stems: dict[str, float]) -> ahocorasick.Automaton:
    """Learned stems and menaces as one automaton: where a clause is worth reading."""
    found = ahocorasick.Automaton()
    for s in {*stems, *MENACES}:
        found.add_word(s, s)
    found.make_automaton()
    return found


def readings(word: str, stems: dict[str, float], whole: frozenset[str]) -> list[tuple[int, float]]:
    """The symbols that a word can stand for, with their weights."""
    out = [(s, 0.0) for s, members in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (MENACE, MENACES)) if word in members]
    if word in whole:
        out.append((INSULT, stems[word]))
    else:
        out += [(INSULT, stems[word[:n]]) for n in STEM_LENGTHS if len(word) >= n and word[:n] in stems and word[:n] not in whole][:1]
    return out or [(OTHER, 0.0)]


def squeezed(found: list[list[tuple[int, float]]]) -> list[list[tuple[int, float]]]:
    """Runs of plain words cut to REACH + 1: after so many each machine stays in its state."""
    out, run = [], 0
    for options in found:
        run = run + 1 if options[0][0] == OTHER else 0
        if run <= REACH + 1:
            out.append(options)
    return out


def spots(low: str, automaton: ahocorasick.Automaton) -> list[int]:
    """Where words of a lower-cased text start with a stem or menace; their clauses are read."""
    at = set()
    for end, stem in automaton.iter(low):
        start = end - len(stem) + 1
        if not start or not (low[start - 1].isalpha() or low[start - 1] == "'"):
            at.add(start)
    return sorted(at)


def count_kinds(text: str | None, automaton: ahocorasick.Automaton, whole: frozenset[str], stems: dict[str, float]) -> tuple[np.ndarray, int, int]:
    """Weight of the accepted paths by kind; the clauses with an accepted path, and the kinds written on them."""
    weights = np.zeros(len(KINDS))
    low = (text or "").lower()
    found = spots(low, automaton)
    if not found:
        return weights, 0, 0
    stops = [m.span() for m in CLAUSE.finditer(low)]
    ends = [a for a, _ in stops]
    clauses, written, done = 0, 0, -1
    for at in found:
        if at < done:
            continue
        k = bisect_right(ends, at)
        left, done = stops[k - 1][1] if k else 0, ends[k] if k < len(ends) else len(low)
        read = [readings(w, stems, whole) for w in WORD.findall(low[left:done])]
        # A reporting clause that ends in a colon opens the clause after it.
        if k and ":" in low[stops[k - 1][0] : left] and any(w in REPORTS for w in WORD.findall(low[stops[k - 2][1] if k > 1 else 0 : stops[k - 1][0]])):
            read.insert(0, [(REPORT, 0.0)])
        _, path = best_path(grammar_machine(), squeezed(read))
        clauses, written = clauses + bool(path), written + len(path)
        for kind, own in path:
            weights[KIND_OF[kind]] += WEIGHTS[KIND_OF[kind]] + own
    return weights, clauses, written


def features(weights: np.ndarray) -> np.ndarray:
    """Saturating weights, so that a long clean text can't add up to a toxic one by length alone."""
    return np.log1p(weights)


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Nonnegative logistic regression of the labels on the kinds, pulled a little towards the grammar's own weights."""
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    prior = np.array(WEIGHTS) / 2
    w, b = prior.copy(), -2.0
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = share * (p - y)
        w = np.maximum(0, w - 0.5 * (x.T @ g + 0.002 * (w - prior)))
        b -= 0.5 * (g.sum() + 0.002 * (b + 2.0))
    return tuple(w.tolist()), float(b)


def unlearned() -> Grammar:
    return Grammar({}, frozenset(), (0.0,) * len(KINDS), math.log(PRIOR / (1 - PRIOR)))


def fit(texts: list[str], labels: list[int]) -> Grammar:
    """The grammar of a few texts in memory."""
    if 0 not in labels or 1 not in labels:
        return unlearned()
    seen: dict[tuple[str, bool], list] = defaultdict(lambda: [0, 0, set()])
    for text, label in zip(texts, labels, strict=True):
        for c, left in stem_rows(text).items():
            seen[c][1 - label] += 1
            if label:
                seen[c][2].add(left)
    stems, whole = choose(((*c, toxic, clean, len(lefts)) for c, (toxic, clean, lefts) in seen.items()), sum(labels), len(labels) - sum(labels))
    automaton = lexer(stems)
    x = np.array([features(count_kinds(t, automaton, whole, stems)[0]) for t in texts])
    return Grammar(stems, whole, *fit_weights(x, np.array(labels, float)))


def judge(text: str | None, grammar: Grammar, automaton: ahocorasick.Automaton) -> tuple[float, int, int, list[float]]:
    """Score, clauses with an accepted path, kinds written on them, and their weight by kind."""
    weights, clauses, written = count_kinds(text, automaton, grammar.whole, grammar.stems)
    z = float(features(weights) @ np.array(grammar.weights) + grammar.bias)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), clauses, written, weights.tolist()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text) of at most TRAIN_ROWS rows a label that aren't held out, by hash of doc_id.

    A doc_id with both labels isn't learned from; one with several texts teaches each of them.
    """
    sides = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("_other"))
    known = sides.where("label = _other").drop("_other")
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(order, "doc_id").limit(TRAIN_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").distinct()  # TRAIN_ROWS ids a label


def learned_stems(rows: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], frozenset[str]]:
    """The stems of `choose`, counted by Spark over (label, text)."""
    arrow = to_arrow(rows, STEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = stem_rows(text)
                if found:
                    columns = [c for c, _ in found], [w for _, w in found], [label] * len(found), list(found.values())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    stems = rows.select("label", "text").mapInArrow(run, STEMS)
    counts = stems.groupBy("cand", "whole").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    near = counts.where((F.col("toxic") >= MIN_SHARE * toxic) & (ratio >= MIN_LOG_ODDS - 0.01))  # `choose` decides
    contexts = stems.where("label = 1").join(near, ["cand", "whole"]).select("cand", "whole", "toxic", "clean", "left").distinct()
    seen = contexts.groupBy("cand", "whole", "toxic", "clean").agg(F.count(F.lit(1)).alias("contexts")).orderBy("cand", "whole").collect()
    return choose((tuple(r) for r in seen), toxic, clean)


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic); what the driver gets is a count for each stem and a short vector for each labelled text."""
    rows = cut(training_rows(docs, labels))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return unlearned()
    stems, whole = learned_stems(rows, totals[1], totals[0])

    def run(batch: dict[str, list]) -> dict[str, list]:
        automaton = lexer(stems)
        return {"label": batch["label"], "x": [features(count_kinds(t, automaton, whole, stems)[0]).tolist() for t in batch["text"]]}

    got = sorted((r["label"], *r["x"]) for r in map_rows(rows, run, "label int, x array<double>").collect())
    table = np.array(got, float)
    return Grammar(stems, whole, *fit_weights(table[:, 1:], table[:, 0]))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per row of `docs` (doc_id, text): score, prediction, and what the grammar accepted."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        automaton = lexer(grammar.stems)
        found = [judge(t, grammar, automaton) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": [f[0] for f in found],
            "predicted": [int(f[0] >= THRESHOLD) for f in found], "n_clauses": [f[1] for f in found],
            "n_matched": [f[2] for f in found], "kinds": [f[3] for f in found],
        }

    return map_rows(docs.select("doc_id", "text").withColumn("held_out", held_out()), run, SCHEMA)


def keep(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, all columns unchanged."""

    def run(texts: list) -> list[bool]:
        automaton = lexer(grammar.stems)
        return [judge(t, grammar, automaton)[0] < THRESHOLD for t in texts]

    return filter_rows(docs, "text", run)
