"""Language ID by cross-parsing: the language whose sample explains a text in the fewest normalised phrases wins.

For each language a suffix automaton of labelled text is built. A text is parsed greedily: each phrase is the longest stretch that occurs
in the sample, found by following the automaton until it has no transition; a letter that the sample lacks is a phrase of its own. With
c phrases over n characters and a sample of m characters, c * log2(m) / n estimates the cross-entropy of the text under the language.

Texts are parsed in lanes of `LANE` characters that advance together, one gather per character and language. A lane is first parsed as if
a phrase began with it. Then the parse that comes out of the lane before runs on into it until both are in one state, from where they
agree; phrases after that point are taken from the first parse, those before it from the second. So counts are those of one parse from
start to end, whatever the lanes.

Training uses a bounded sample: `SAMPLE_DOCS` whole documents per language by a hash of the id, none longer than `SAMPLE_CHARS` characters
unless the language has no shorter one. Every language has its own alphabet; transitions on its `DENSE_CELLS` / states most frequent
letters are a table, those on the others a sorted list, so the size of an alphabet changes the layout and not the result. Everything that
is predicted is parsed in whole. The driver holds the sample: rows in proportion to the number of languages.

Defined results: a null text or one without a letter is `und` with score 0; characters other than letters count as one gap; letters no
sample holds are a phrase each; ties go to the language that comes first; without any labelled document everything is `und`;
repeated rows and null ids are rows as any other; an empty table gives an empty table; other columns are ignored by `identify`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meltframe.llm.common import per_worker, tidy

UNKNOWN_LANGUAGE = "und"
SAMPLE_DOCS = 20
SAMPLE_CHARS = 8_192
# Cells of the table of one automaton.
DENSE_CELLS = 8_000_000
LANE = 512
CHARS_AT_ONCE = 700_000


def training_sample(docs: DataFrame, learn: Column) -> dict[str, list[str]]:
    """Whole texts by language from the rows that `learn` admits: the documents with the smallest hashes."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.col("doc_id"), F.length("text")).alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(~F.col("long"), 1)).alias("short")).collect()
    if not counts:
        return {}
    # a threshold on the hash leaves some times the rows wanted, which are then ranked
    bounds = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4.0 * SAMPLE_DOCS / (r["short"] or r["n"]))))])
    only_long = F.col("lang").isin([r["lang"] for r in counts if not r["short"]])
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = usable.where((share < bounds[F.col("lang")]) & (~F.col("long") | only_long)).select("lang", "h", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))
    sample: dict[str, list[str]] = {}
    for row in few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).orderBy("lang", "rank").collect():
        sample.setdefault(row["lang"], []).append(row["text"])
    return sample


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of every state; state 0 is the start and every path from it spells a substring."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following


class Automaton:
    """One language's suffix automaton as arrays; a step takes many states at once.

    A state is its number times the width of the table. A cell is the next state times four, plus the phrases that end on the way: none
    inside a phrase, one where a phrase ends before the character, and one more for a character that the sample lacks.
    """

    def __init__(self, codes: list[int], letters: int, dense_cells: int | None = None):
        """`codes` below `letters`, the more frequent ones first."""
        states = suffix_automaton(codes)
        self.bits = float(np.log2(max(2, len(codes))))
        self.alphabet = float(np.log2(max(2, letters)))
        n = len(states)
        dense = min(letters, max(1, (DENSE_CELLS if dense_cells is None else dense_cells) // n))
        # columns: dense letters, a letter the sample lacks, padding, a letter of the list
        self.absent, self.pad, self.listed = dense, dense + 1, dense + 2
        self.width = dense + 3
        kind = np.int32 if n * self.width < 1 << 29 else np.int64
        sizes = np.fromiter(map(len, states), np.int64, n)
        start = np.repeat(np.arange(n), sizes)
        code = np.fromiter(chain.from_iterable(states), np.int64, int(sizes.sum()))
        cell = np.fromiter(chain.from_iterable(s.values() for s in states), np.int64, len(code)) * (self.width << 2)
        root = np.ones(letters, np.int64)  # a letter without a transition from the root is lacking: back to the root, one phrase
        for c, state in states[0].items():
            root[c] = state * (self.width << 2)
        table = np.empty((n, self.width), kind)
        table[:, :dense] = root[:dense]
        table[:, [self.absent, self.listed]] = 1
        table[1:] += 1  # the running phrase ends
        table[:, self.pad] = np.arange(n) * (self.width << 2)
        inside = code < dense
        table[start[inside], code[inside]] = cell[inside]
        self.table = table.ravel()
        self.rare = letters - dense
        key = start[~inside] * max(1, self.rare) + code[~inside] - dense
        order = np.argsort(key)
        self.keys, self.cells, self.root = key[order], cell[~inside][order], root[dense:]

    def columns(self, code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """For codes of this language (-1: none): the table's column, and the place in the list's alphabet or -1."""
        dense = self.width - 3
        column = np.where(code_of < 0, self.absent, np.where(code_of < dense, code_of, self.listed)).astype(np.int32)
        return column, np.where(code_of >= dense, code_of - dense, -1).astype(np.int32) if self.rare else None

    def step(self, state: np.ndarray, column: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
        cell = self.table[state + column]
        if rare is not None and len(at := np.flatnonzero(rare >= 0)):
            here, letter = state[at], rare[at]
            key = here // self.width * self.rare + letter
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            cell[at] = np.where(self.keys[spot] == key, self.cells[spot], self.root[letter] + (here != 0))
        return cell

    def phrases(self, column: np.ndarray, rare: np.ndarray | None, first: np.ndarray) -> np.ndarray:
        """Phrases of every text; lanes are columns, text i has the lanes first[i]:first[i + 1]."""
        steps, lanes = column.shape
        states, ended = np.empty((steps, lanes), self.table.dtype), np.empty((steps, lanes), np.uint8)
        state = np.zeros(lanes, self.table.dtype)
        for t in range(steps):
            cell = self.step(state, column[t], None if rare is None else rare[t])
            ended[t] = cell & 3
            state = states[t] = cell >> 2
        own = ended.sum(axis=0, dtype=np.int64)
        begins = np.zeros(lanes + 1, bool)
        begins[first] = True
        end, change = state.copy(), np.zeros(lanes, np.int64)
        # lanes whose text comes into them within a phrase
        todo = np.flatnonzero(~begins[1:-1] & (end[:-1] != 0)) + 1
        start = np.concatenate([[0], end[:-1]])
        while len(todo):
            at, now = todo, start[todo]
            true, lane = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            fresh = state.copy()
            for t in range(steps):
                cell = self.step(now, column[t, at], None if rare is None else rare[t, at])
                true += cell & 3
                lane += ended[t, at]
                now = cell >> 2
                apart = now != states[t, at]
                if not apart.all():
                    met = ~apart
                    change[at[met]] = true[met] - lane[met]
                    at, now, true, lane = at[apart], now[apart], true[apart], lane[apart]
                    if not len(at):
                        break
            change[at] = true - lane
            fresh[at] = now  # they never met: the lane ends in another state than its own parse did
            moved = todo[fresh[todo] != end[todo]]
            end[todo] = fresh[todo]
            todo = moved[~begins[moved + 1]] + 1
            start[todo] = end[todo - 1]
        total = np.concatenate([[0], np.cumsum(own + change)])
        filled = np.flatnonzero(np.diff(first))
        out = total[first[1:]] - total[first[:-1]]
        out[filled] += end[first[filled + 1] - 1] != 0  # the last phrase
        return out


class Parser:
    """Automata of all languages, and one code per letter of any sample: gap 0, letters, one code for other letters."""

    GAP = 0

    def __init__(self, sample: dict[str, list[str]], dense_cells: int | None = None):
        self.languages = sorted(sample)
        letters = sorted({c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()})
        self.other = len(letters) + 1
        points = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.where(points, self.other, self.GAP).astype(np.int32)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.automata, self.columns = [], []
        for language in self.languages:
            codes = self.codes(" ".join(sample[language]))
            counts = np.bincount(codes, minlength=self.other + 2)
            used = np.flatnonzero(counts)
            own = np.full(self.other + 2, -1, np.int64)
            own[used[np.argsort(-counts[used], kind="stable")]] = np.arange(len(used))
            automaton = Automaton(own[codes].tolist(), len(used), dense_cells)
            column, rare = automaton.columns(own)
            column[self.other + 1] = automaton.pad
            self.automata.append(automaton)
            self.columns.append((column, rare))

    def codes(self, text: str) -> np.ndarray:
        """Codes of a text with every run of gaps as one."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = codes == self.GAP
        return codes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(codes) else codes

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the language explains the text, for each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN_LANGUAGE, 0.0, False)] * len(texts)
        if not self.languages:
            return out
        coded = [self.codes(t) if t else np.empty(0, np.int32) for t in texts]
        start = 0
        while start < len(coded):
            stop, size = start, 0
            while stop < len(coded) and (stop == start or size + len(coded[stop]) <= CHARS_AT_ONCE):
                size += len(coded[stop])
                stop += 1
            for i, result in zip(range(start, stop), self._identify(coded[start:stop])):
                out[i] = result
            start = stop
        return out

    def counts(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (a column) in each language (a line)."""
        parts = np.array([-(-len(c) // LANE) for c in coded])
        first = np.concatenate([[0], np.cumsum(parts)])
        lanes = np.full((int(first[-1]), LANE), self.other + 1, np.int32)
        for codes, at, n in zip(coded, first, parts):
            if n:
                lanes[at:at + n].reshape(-1)[:len(codes)] = codes
        lanes = np.ascontiguousarray(lanes.T)
        return np.array([a.phrases(column[lanes], None if rare is None else rare[lanes], first)
                         for a, (column, rare) in zip(self.automata, self.columns)])

    def _identify(self, coded: list[np.ndarray]) -> Iterator[tuple[str, float, bool]]:
        lengths = np.array([len(c) for c in coded])
        counts = self.counts(coded)
        bits = np.array([a.bits for a in self.automata])
        cost = counts * bits[:, None] / np.maximum(lengths, 1)
        for i, codes in enumerate(coded):
            if not (codes != self.GAP).any():
                yield UNKNOWN_LANGUAGE, 0.0, False
                continue
            order = np.argsort(cost[:, i], kind="stable")
            top = int(order[0])
            best = float(cost[top, i])
            second = float(cost[order[1], i]) if len(order) > 1 else float("inf")
            # phrases must be cheaper than the letters one by one; the first phrase is free, so that a single word can pass
            explains = (counts[top, i] - 1) * bits[top] < lengths[i] * self.automata[top].alphabet
            yield self.languages[top], 1.0 if second == float("inf") else second / (best + second), bool(explains)


def _parser(sample: dict[str, list[str]]):
    name = hashlib.sha256(json.dumps(sample, sort_keys=True).encode()).hexdigest()
    return lambda: per_worker(("language parser", name), lambda: Parser(sample))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield batch.slice(start, 512)


def identify(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    parser = _parser(sample)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = parser().identify(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """Rows written in one of the sample's languages, with all their columns; a null `lang` becomes the language found.

    Rows without text or without a letter go, and those whose best language takes more bits for its phrases than a list of the letters
    would: no language explains them.
    """
    parser, column, lang = _parser(sample), docs.columns.index("text"), docs.columns.index("lang")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = parser().identify(batch.column(column).to_pylist())
            filled = pc.coalesce(batch.column(lang), pa.array([f[0] for f in found], batch.column(lang).type))
            arrays = [filled if i == lang else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names).filter(pa.array([f[2] for f in found], pa.bool_()))
        tidy()

    return docs.mapInArrow(known, docs.schema)
