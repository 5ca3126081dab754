"""Toxicity: a learned lexicon matched through Levenshtein automata, and context windows that tell quotation from abuse.

1. Lexicon. Over all labelled training rows, the documents that hold a word or a word beginning are counted by label; those that tie to
   toxic documents beyond chance (likelihood ratio above twice the log of the number of candidates) are the terms, words or stems,
   however many these are. Only they reach the driver, as part of the model.
2. Matching. The terms form a trie. Running the Levenshtein automata of all terms at once is a search over sets of (trie node, errors);
   these sets are the states of one deterministic automaton, built as far as tokens need it. A token costs one step per character and
   most leave the automaton after three or four.
3. Context. Around every match a window of words is read. The words that stand in the windows of other rows beyond chance are words
   of report, those of toxic rows words of address; both are learned from all different windows of the training rows. Quotation
   marks are fixed; matches inside quotation count apart from the others.
4. A logistic regression over these counts is fitted to at most `FIT_ROWS` labelled rows and applied to every whole text.

Defined results: a null text is empty; a text without a match gets the score the regression gives to no match; without labelled
rows of both kinds every score is the share of toxic ones (0 without any); of several labels for one id the largest counts, null labels
do not; repeated rows and null ids are rows as any other (a null id is never held out); an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltframe.llm.common import maybe_broadcast, per_worker
from meltframe.session import stored

# Labelled rows the regression is fitted to.
FIT_ROWS = 20_000
MIN_TOXIC = 3
STEMS = (4, 5, 6)
WINDOW = 6
# Tokens a worker remembers.
REMEMBERED = 300_000
OPENING, CLOSING, EITHER = "“«„‹", "”»‟›", "\"'`"
FEATURES = 8


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)  # (text, is a stem)
    report: list[str] = field(default_factory=list)  # words that tell of a term
    address: list[str] = field(default_factory=list)  # words that throw it at somebody
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    prior: float = 0.0


def errors_allowed(term: str, stem: bool) -> int:
    """Edits at which a token still counts as the term: none for short ones, which have too many neighbours."""
    if stem:
        return 0
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Matcher:
    """The deterministic automaton of all terms' Levenshtein automata, intersected with their trie."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]
        self.allowed = [0]
        for term, stem in terms:
            limit, node = errors_allowed(term, stem), 0
            self.allowed[0] = max(self.allowed[0], limit)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], limit)
            known = self.ends[node]
            self.ends[node] = (max(limit, known[0]), stem or known[1]) if known else (limit, stem)
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, bool] | None] = []
        self.start = self.number({0: 0})

    def number(self, positions: dict[int, int]) -> int:
        """State for the least errors per trie node; -1 for none. Skipped characters of terms are followed here."""
        waiting = list(positions.items())
        while waiting:
            node, errors = waiting.pop()
            if positions[node] < errors:
                continue
            for child in self.children[node].values():
                if errors < self.allowed[child] and positions.get(child, 99) > errors + 1:
                    positions[child] = errors + 1
                    waiting.append((child, errors + 1))
        if not positions:
            return -1
        key = frozenset(positions.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.ends[n][1]) for n, e in key if self.ends[n] and e <= self.ends[n][0]]
            self.accepts.append(min(ends, default=None))
        return self.numbers[key]

    def step(self, state: int, c: str) -> int:
        positions: dict[int, int] = {}

        def put(node: int, errors: int) -> None:
            if errors <= self.allowed[node] and positions.get(node, 99) > errors:
                positions[node] = errors

        for node, errors in self.sets[state]:
            put(node, errors + 1)  # c is not in the term
            for name, child in self.children[node].items():
                put(child, errors if name == c else errors + 1)
        following = self.steps[state][c] = self.number(positions)
        return following

    def match(self, token: str) -> int | None:
        """Errors of the closest term, or None."""
        if len(self.sets) > 50_000:  # as many states as a worker should hold: build anew
            self.numbers, self.sets, self.steps, self.accepts = {}, [], [], []
            self.start = self.number({0: 0})
        state, best = self.start, None
        for c in token:
            following = self.steps[state].get(c)
            state = self.step(state, c) if following is None else following
            if state < 0:
                return best
            end = self.accepts[state]
            if end and end[1] and (best is None or end[0] < best):
                best = end[0]  # a stem needs no more of the token
        end = self.accepts[state]
        return best if end is None else end[0] if best is None else min(best, end[0])


class Reader:
    """Features of whole texts under a model's terms and words of context."""

    EDGE = re.compile(r"^\W+|\W+$")

    def __init__(self, terms: list[tuple[str, bool]], report: Sequence[str] = (), address: Sequence[str] = ()):
        self.matcher = Matcher([tuple(t) for t in terms])
        self.report, self.address = frozenset(report), frozenset(address)
        self.known: dict[str, int] = {}

    def errors(self, token: str) -> int:
        """Errors of the closest term for a token as it stands in the text; -1 for no match."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            match = self.matcher.match(self.EDGE.sub("", token))
            found = self.known[token] = -1 if match is None else match
        return found

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        """Whether the token stands between quotation marks within its window."""
        before = " ".join(tokens[max(0, at - WINDOW):at])
        after = " ".join(tokens[at + 1:at + 1 + WINDOW])
        own = tokens[at]
        core = Reader.EDGE.sub("", own)
        head, _, tail = own.partition(core) if core else (own, "", "")
        before, after = f"{before} {head}", f"{tail} {after}"
        for opening, closing in zip(OPENING, CLOSING):
            if before.rfind(opening) > before.rfind(closing) and closing in after:
                return True
        # a mark that opens and closes alike opens where a blank or nothing stands before it
        for mark in EITHER:
            opens = re.search(rf"(?:^|[\s(\[]){re.escape(mark)}(?=[^\s{re.escape(mark)}]|$)[^{re.escape(mark)}]*$", before)
            closes = re.search(rf"^[^{re.escape(mark)}]*{re.escape(mark)}(?:$|[\s.,;:!?)\]])", after)
            if opens and closes:
                return True
        return False

    def hits(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(place, errors) of the tokens that match."""
        known = self.known
        hits = []
        for i, token in enumerate(tokens):
            errors = known.get(token)
            if errors is None:
                errors = self.errors(token)
            if errors >= 0:
                hits.append((i, errors))
        return hits

    def around(self, tokens: list[str], at: int) -> list[str]:
        """The words of the window, without their punctuation."""
        return [self.EDGE.sub("", t) for t in tokens[max(0, at - WINDOW):at + 1 + WINDOW]]

    def windows(self, text: str) -> set[tuple[str, ...]]:
        """The different windows around matches, without the words that match."""
        tokens = text.lower().split()
        return {tuple(w for w in self.around(tokens, i) if w and self.errors(w) < 0) for i, _ in self.hits(tokens)}

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        hits = self.hits(tokens)
        if not hits:
            return [0.0] * (FEATURES - 1) + [math.log1p(len(tokens))]
        plain = fuzzy = quoted = report = address = 0
        places = []
        for i, errors in hits:
            window = self.around(tokens, i)
            report += not self.report.isdisjoint(window)
            address += not self.address.isdisjoint(window)
            if self.quoted(tokens, i):
                quoted += 1
                continue
            places.append(i)
            plain, fuzzy = plain + (errors == 0), fuzzy + (errors > 0)
        # the most matches that stand within one window
        ends = np.searchsorted(places, np.array(places) + 2 * WINDOW, "right") if places else np.zeros(1, int)
        densest = int((ends - np.arange(len(ends))).max())
        return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), report / len(hits), address / len(hits),
                math.log1p(max(0, densest)), 100 * (plain + fuzzy) / (len(tokens) + 20), math.log1p(len(tokens))]


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: doc_id, text, toxic."""
    known = stored(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")))
    return docs.select("doc_id", "text").join(maybe_broadcast(known, known.count()), "doc_id")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def _terms_of(words: Column) -> Column:
    """Distinct words and their beginnings, the latter marked with a star."""
    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *[beginnings(n) for n in STEMS]))


def _terms(rows: DataFrame) -> DataFrame:
    """term: a row per document and term in it."""
    # the words are a column of their own, so that they are found once and not for each use
    words = rows.select(F.array_distinct(_words(F.col("text"))).alias("words"))
    return words.select(F.explode(_terms_of(F.col("words"))).alias("term"))


def _settings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, places): before how many different words each of the terms stands.

    Copies of one toxic document repeat all its words, but each with the same word before it; a word that makes documents
    toxic stands in many places.
    """
    words = rows.select(_words(F.col("text")).alias("words"))
    pairs = words.select(F.explode(F.transform("words", lambda w, i: F.struct(
        w.alias("word"), F.coalesce(F.get("words", i - 1), F.lit("")).alias("before")))).alias("p")).select("p.*").distinct()
    ends = F.array(F.col("word"), *[F.concat(F.substring("word", 1, n), F.lit("*")) for n in STEMS])
    return pairs.select(F.explode(ends).alias("term"), "before").join(terms, "term").groupBy("term").agg(
        F.count_distinct("before").alias("places"))


def likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """G statistic of a term in a of n_a toxic and b of n_b other rows; 0 where it is no more frequent in toxic ones."""
    def times_log(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / mean)).otherwise(0.0)

    rate = (a + b) / F.lit(float(n_a + n_b))
    g = sum((times_log(x, n * rate) + times_log(n - x, n * (1 - rate)) for x, n in ((a, F.lit(float(n_a))), (b, F.lit(float(n_b))))), F.lit(0.0))
    return F.when(a / n_a > b / n_b, 2 * g).otherwise(0.0)


def choose_terms(strong: dict[str, tuple[float, float]]) -> list[tuple[str, bool]]:
    """Words and stems from the (statistic, toxic rows) of the words and beginnings over the threshold."""
    chosen: dict[tuple[str, bool], float] = {}
    stems = sorted((s[:-1] for s in strong if s.endswith("*")), key=lambda s: (len(s), s))
    below: dict[str, list[str]] = {s: [] for s in stems}  # what begins with a strong beginning, itself included
    for name in sorted(strong):
        for n in STEMS:
            if len(name.rstrip("*")) >= n and name[:n] in below:
                below[name[:n]].append(name)
    # words and stems below each strong beginning, from the longest stem that keeps nearly all its documents
    for stem in stems:
        if any((stem[:n], True) in chosen for n in STEMS):
            continue
        word = max((w for w in below[stem] if not w.endswith("*")), key=lambda w: (strong[w][1], w), default=None)
        if word and strong[word][1] >= 0.8 * strong[stem + "*"][1]:
            chosen[word, False] = strong[word][0]
            continue
        longer = [s[:-1] for s in below[stem] if s.endswith("*") and strong[s][1] >= 0.95 * strong[stem + "*"][1]]
        best = max(longer, key=lambda s: (len(s), s))
        chosen[best, True] = strong[best + "*"][0]
    for word in (w for w in strong if not w.endswith("*")):
        if (word, False) not in chosen and not any((word[:n], True) in chosen for n in STEMS):
            chosen[word, False] = strong[word][0]
    return sorted(chosen, key=lambda t: (-chosen[t], t))


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Toxic and other rows."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    return totals.get(1, 0), sum(n for t, n in totals.items() if t != 1)


def learn_terms(rows: DataFrame) -> list[tuple[str, bool]]:
    """The lexicon, from all training rows: beginnings and words of toxic rows first, then the others' counts of those."""
    n_toxic, n_other = _totals(rows)
    if not n_toxic or not n_other:
        return []
    candidates = stored(_terms(rows.where("toxic = 1")).groupBy("term").agg(F.count("*").alias("a")).where(F.col("a") >= MIN_TOXIC))
    n = candidates.count()
    others = _terms(rows.where("toxic <> 1")).join(maybe_broadcast(candidates.select("term"), n), "term").groupBy("term").agg(
        F.count("*").alias("b"))
    # a term that could not reach the threshold even without any other document needs no settings
    rate = n_toxic / (n_toxic + n_other)
    least = math.ceil(math.log(max(2, n)) / -math.log(rate)) if rate < 1 else MIN_TOXIC
    counted = candidates.where(F.col("a") >= least).join(others, "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    likely = stored(counted.where((F.col("b") / n_other < F.lit(0.1) * F.col("a") / n_toxic)))
    places = _settings(rows.where("toxic = 1"), maybe_broadcast(likely.select("term"), likely.count()))
    # a term counts for no more documents than it has settings
    likely = likely.join(places, "term").select("term", F.least("a", "places").alias("a"), "b")
    strong = likely.withColumn("g", likelihood_ratio(F.col("a"), F.col("b"), n_toxic, n_other)).where(
        (F.col("g") >= 2 * math.log(max(2, n))) & (F.col("b") / n_other < F.lit(0.1) * F.col("a") / n_toxic))
    return choose_terms({r["term"]: (r["g"], r["a"]) for r in strong.collect()})


def learn_context(rows: DataFrame, terms: list[tuple[str, bool]]) -> tuple[list[str], list[str]]:
    """Words of report and of address: those that more of the different windows of other (of toxic) rows hold than chance has it.

    Windows count once for each label, so that the copies of a text weigh as one.
    """
    def finish(reader: Reader, batch: pa.RecordBatch) -> tuple[list[str], list[pa.Array]]:
        found = [[list(w) for w in sorted(reader.windows(t or ""))] for t in batch["text"].to_pylist()]
        return ["windows"], [pa.array(found, pa.list_(pa.list_(pa.string())))]

    if not terms:
        return [], []
    listed = rows.select("toxic", "text").mapInArrow(_read(Model(terms), ["toxic"], finish), "toxic int, windows array<array<string>>")
    windows = stored(listed.select((F.col("toxic") == 1).cast("int").alias("toxic"), F.explode("windows").alias("w")).distinct())
    n_toxic, n_other = _totals(windows)
    if not n_toxic or not n_other:
        return [], []
    counts = stored(windows.select("toxic", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= MIN_TOXIC))
    least = 2 * math.log(max(2, counts.count()))
    a, b = F.col("a"), F.col("b")
    report = counts.where(likelihood_ratio(b, a, n_other, n_toxic) >= least)
    address = counts.where(likelihood_ratio(a, b, n_toxic, n_other) >= least)
    return [sorted(r["word"] for r in words.select("word").collect()) for words in (report, address)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Weights (constant first) of a logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(curve, slope)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return [round(float(v), 9) for v in w]


def _read(model: Model, keep: list[str], finish: Callable[[Reader, pa.RecordBatch], tuple[list[str], list[pa.Array]]]):
    """Batches with the columns `keep` and those that `finish` makes of the texts with the model's reader."""
    words = (model.terms, model.report, model.address)
    name = hashlib.sha256(json.dumps(words).encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = per_worker(("toxicity reader", name), lambda: Reader(*words))
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                names, arrays = finish(reader, batch)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *arrays], [*keep, *names])
    return read


def _features(reader: Reader, batch: pa.RecordBatch) -> np.ndarray:
    return np.array([reader.features(t or "") for t in batch["text"].to_pylist()]).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and words of context from all training rows, weights from about FIT_ROWS of them: those with the least hashes of
    their ids, 2 * FIT_ROWS at most."""
    rows = labelled(docs, labels)
    model = Model(terms=learn_terms(rows))
    model.report, model.address = learn_context(rows, model.terms)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.select("toxic", "text", share.alias("share")).where(F.col("share") < min(1.0, FIT_ROWS / max(1, rows.count())))
    listed = _read(model, ["share", "toxic"], lambda r, batch: (["x"], [pa.array(list(_features(r, batch)), pa.list_(pa.float64()))]))
    fitted = some.select("share", "toxic", "text").mapInArrow(listed, "share double, toxic int, x array<double>").orderBy(
        "share", "toxic", "x").limit(2 * FIT_ROWS).collect()
    y = np.array([float(r["toxic"] == 1) for r in fitted])
    model.prior = float(y.mean()) if len(y) else 0.0
    if 0 < y.sum() < len(y):
        order = np.lexsort(np.array([r["x"] for r in fitted]).T)
        model.weights = fit(np.array([r["x"] for r in fitted])[order], y[order])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    weights, prior = np.array(model.weights), model.prior

    def finish(reader: Reader, batch: pa.RecordBatch) -> tuple[list[str], list[pa.Array]]:
        x = _features(reader, batch)
        if not weights.any():
            return ["score"], [pa.array(np.full(len(x), prior))]
        return ["score"], [pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_read(model, ["doc_id"], finish), "doc_id long, score double")
