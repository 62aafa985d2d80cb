"""Toxicity scores from a weighted finite-state grammar.

A clause is read as a string of symbols: insult, threat, target, negation, report, quote, other. Small
transducers each follow one kind of context (negation scope, target before or after, reported speech,
threat and whom it names) and mark insults and threats; they are composed into one table that is run over every
clause that holds an insult or a threat. A marked insult counts its weight times the factors of its marks. A document is
judged by its matched clauses (sum, strongest, number, distinct cues, share of the words, marks), not by single words.

Insults are weighted cues, whole words and stems of three to eight letters, learned from labelled
documents: a cue stays where its share of toxic documents cannot be chance, given how many cues are tried, and weighs its log odds.
They form a trie; a word takes the heaviest cue it accepts. Targets, negations, reports and threats are the fixed lists
below. A logistic fit turns clause figures into a probability; its training figures come from cues learned on the
other folds, so cues that fit only their own documents do not count.

Fitted on at most ``FIT_ROWS`` labelled documents (smallest md5 of the id) whose crc32(id) mod 3 is not 1. Every whole text is scored.

Defined results: a null or empty text has no clause and gets the score of a text without a match; without usable
labels every score is 0; repeated rows are scored alike, each on its own; labels other than 0 and 1 are ignored; an empty
table gives no rows; other columns are neither read nor needed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.llm.texts import slices
from onsetframe.llm.words import Words, byte_kinds, segments
from onsetframe.session import checkpointed

FIT_ROWS = 20_000
TOXIC_FROM = 0.7
FOLDS = 4
STEMS = range(3, 9)
LEAST_DOCUMENTS = 3  # toxic documents a cue is in at least
LEAST_WEIGHT, MOST_WEIGHT = 1.5, 8.0
RIDGE = 1.0
# letters, digits, quotation marks and apostrophes form words
_BREAKS = b".;:!?\n\x0b\x0c\r"
_GAPS = bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i) in "\"'") and i not in _BREAKS)
KINDS = byte_kinds(_GAPS, _BREAKS)
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_QUOTES = "\"“”„«»"

# fixed word lists
TARGETS = set("you your yours yourself u he him she her they them du dich dir dein deine ihr euch euer sie er tu te toi ton ta "
              "vous votre vos il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = set("not no never none isn't aren't wasn't weren't don't doesn't nicht kein keine keinen nie niemals ne pas jamais "
                "aucun aucune nunca jamás ni tampoco".split())
REPORTS = set("said says say saying called calls told quoted wrote writes reported allegedly sagte sagt nannte schrieb angeblich "
              "dit disait appelé écrit raconté dijo dice llamó escribió".split())
THREATS = set("kill hurt destroy beat burn shoot stab hang töten umbringen verletzen schlagen verbrennen erschießen tuer "
              "frapper brûler blesser égorger matar golpear quemar herir disparar".split())

OTHER, TARGET, NEGATION, REPORT, QUOTE, THREAT, INSULT = range(7)
NEGATED, AIMED, REPORTED, THREATENS, TAKEN_BACK = 1, 2, 4, 8, 16
FACTORS = {NEGATED: 0.4, AIMED: 1.5, REPORTED: 0.5}
THREAT_WEIGHT = 4.0
FIGURES = ["total", "strongest", "clauses", "cues", "share", "aimed", "negated", "reported", "threats"]


# --- transducers ----------------------------------------------------------------------


@dataclass
class Transducer:
    """``step(state, symbol)`` gives the next state and the marks it writes; states are small integers, 0 is the start."""

    step: Callable[[int, int], tuple[int, int]]


def scope(opened_by: int, words: int, mark: int) -> Transducer:
    """Marks an insult or threat up to ``words`` words after a symbol."""

    def step(left: int, symbol: int) -> tuple[int, int]:
        if symbol == opened_by:
            return words, 0
        return max(left - 1, 0), mark if left and symbol in (INSULT, THREAT) else 0

    return Transducer(step)


def followed(opened_by: int, words: int, mark: int) -> Transducer:
    """Marks a target up to ``words`` words after a symbol."""

    def step(left: int, symbol: int) -> tuple[int, int]:
        if symbol == opened_by:
            return words, 0
        if left and symbol == TARGET:
            return 0, mark
        return max(left - 1, 0), 0

    return Transducer(step)


def reported_speech() -> Transducer:
    """From a word of reporting to the end of the clause, and between quotation marks."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        told, quoted = state & 1, state & 2
        if symbol == REPORT:
            return 1 | quoted, 0
        if symbol == QUOTE:
            return told | (quoted ^ 2), 0
        return state, REPORTED if state and symbol in (INSULT, THREAT) else 0

    return Transducer(step)


def composed(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """One machine of the reachable states of all: tables of next states and marks by state and symbol."""
    numbers, todo, nexts, marks = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    for states in todo:
        row, written = [], []
        for symbol in range(INSULT + 1):
            moves = [m.step(s, symbol) for m, s in zip(machines, states)]
            to = tuple(s for s, _ in moves)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
            written.append(sum(mark for _, mark in moves))
        nexts.append(row)
        marks.append(written)
    return np.array(nexts), np.array(marks)


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    nexts, marks = composed([
        scope(NEGATION, 3, NEGATED), scope(TARGET, 4, AIMED), reported_speech(),
        followed(THREAT, 3, THREATENS), followed(INSULT, 2, TAKEN_BACK),
    ])
    return nexts.tolist(), marks.tolist()


# --- cues -----------------------------------------------------------------------------


@dataclass
class Cues:
    """A trie of weighted words and stems."""

    root: dict = field(default_factory=dict)

    def add(self, cue: str, weight: float) -> None:
        stem = cue.endswith("*")
        node = self.root
        for c in cue.rstrip("*"):
            node = node.setdefault(c, {})
        node["*" if stem else "$"] = weight

    def weight(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("*", 0.0))
        return max(best, node.get("$", 0.0))


def cues_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if n <= len(word)]]


def plain(word: bytes) -> str:
    return _EDGE.sub("", word.decode().lower())


def learned(cues: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Cues:
    """The cues whose share of toxic documents cannot be chance (a Chernoff bound below one over the cues tried)."""
    out = Cues()
    tried = toxic >= LEAST_DOCUMENTS
    if not tried.any() or not n_clean:
        return out
    base, both = n_toxic / (n_toxic + n_clean), toxic + clean
    share = np.clip(toxic / np.maximum(both, 1), 1e-9, 1 - 1e-9)
    surprise = both * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    keep = tried & (share > base) & (surprise > np.log(tried.sum())) & (weight >= LEAST_WEIGHT)
    for i in np.flatnonzero(keep):
        out.add(cues[i], float(min(weight[i], MOST_WEIGHT)))
    return out


# --- figures of a text ----------------------------------------------------------------


def symbols(words: Words, cues: Cues) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Symbol, insult weight and quotation marks (at its start 1, at its end 2) of each distinct word."""
    kind, weight, quoted, texts = [], [], [], []
    for raw in words.distinct.to_pylist():
        text = raw.decode()
        word = _EDGE.sub("", text.lower())
        heavy = cues.weight(word)
        kind.append(
            INSULT if heavy else THREAT if word in THREATS else REPORT if word in REPORTS
            else NEGATION if word in NEGATIONS else TARGET if word in TARGETS else OTHER
        )
        weight.append(heavy)
        quoted.append((text[0] in _QUOTES) + 2 * (len(text) > 1 and text[-1] in _QUOTES))
        texts.append(word)
    return np.array(kind, np.int8), np.array(weight), np.array(quoted, np.int8), texts


class Tally:
    """Figures of one text's matched clauses."""

    def __init__(self) -> None:
        self.total = self.strongest = 0.0
        self.words = self.clauses = self.aimed = self.negated = self.reported = self.threats = 0
        self.cues: set[str] = set()

    def clause(self, kind: list[int], weight: list[float], quoted: list[int], texts: list[str], nexts, marks) -> None:
        state, score = 0, 0.0
        for k, w, q, text in zip(kind, weight, quoted, texts):
            if q & 1:
                state = nexts[state][QUOTE]
            written = marks[state][k]
            state = nexts[state][k]
            if q & 2:
                state = nexts[state][QUOTE]
            if k == INSULT:
                for mark, factor in FACTORS.items():
                    if written & mark:
                        w *= factor
                score += w
                self.cues.add(text)
                self.aimed += bool(written & AIMED)
            if k in (INSULT, THREAT):
                self.negated += bool(written & NEGATED)
                self.reported += bool(written & REPORTED)
            if written & THREATENS:
                score += THREAT_WEIGHT
                self.threats += 1
            self.aimed += bool(written & TAKEN_BACK)
        if score:
            self.clauses += 1
            self.total += score
            self.strongest = max(self.strongest, score)

    def figures(self) -> list[float]:
        logs = (self.total, self.strongest, self.clauses, len(self.cues))
        share = 10 * self.total / (self.words + 20)
        return [*np.log1p(logs).tolist(), share, *np.log1p((self.aimed, self.negated, self.reported, self.threats)).tolist()]


def figures(batch: pa.RecordBatch, cues_for: list[Cues], which: np.ndarray, machine) -> np.ndarray:
    """Rows of ``FIGURES``; text ``i`` is read with ``cues_for[which[i]]``."""
    nexts, marks = machine
    tallies = [Tally() for _ in range(batch.num_rows)]
    for words in segments(batch, KINDS):
        for row, n in zip(*np.unique(words.row, return_counts=True)):
            tallies[row].words += int(n)
        edges = np.r_[0, np.flatnonzero(np.diff(words.piece)) + 1, len(words.ids)]
        for one in np.unique(which[words.row]):
            kind, weight, quoted, texts = symbols(words, cues_for[one])
            of = kind[words.ids]
            hits = np.flatnonzero((of >= THREAT) & (which[words.row] == one))
            for c in np.unique(np.searchsorted(edges, hits, side="right") - 1):
                at = words.ids[edges[c] : edges[c + 1]]
                tallies[words.row[edges[c]]].clause(
                    kind[at].tolist(), weight[at].tolist(), quoted[at].tolist(), [texts[i] for i in at], nexts, marks
                )
    return np.array([t.figures() for t in tallies]).reshape(-1, len(FIGURES))


# --- fit and score --------------------------------------------------------------------


@dataclass
class Model:
    cues: Cues
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the scaled figures, then the constant

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps of a ridge-bound logistic regression on scaled figures."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    w, bound = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(bound), z.T @ (y - p) - bound * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return middle, spread, w


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def training_documents(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``fold, toxic, text`` of at most ``rows`` labelled documents outside the held-out third (kept)."""
    digest = F.md5(F.col("doc_id").cast("string"))
    chosen = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(digest, "doc_id", "toxic").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    # never more than ``rows`` narrow rows
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return checkpointed(joined.select(fold.alias("fold"), "toxic", "text"))


def cue_counts(sample: DataFrame) -> pa.Table:
    """``cue, toxic, clean``: documents with the cue by fold; cues of too few toxic documents are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            kind = (2 * batch.column("fold").to_numpy() + batch.column("toxic").to_numpy()).tolist()
            for words in segments(batch, KINDS):
                texts = [cues_of(w) if (w := plain(raw)) else [] for raw in words.distinct.to_pylist()]
                pairs = np.unique(words.row * len(texts) + words.ids)
                rows, first = np.unique(pairs // max(len(texts), 1), return_index=True)
                for row, own in zip(rows, np.split(pairs % max(len(texts), 1), first[1:])):
                    counts.update((c, kind[row]) for c in {c for i in own for c in texts[i]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                ["cue", "kind", "n"],
            )

    counted = sample.mapInArrow(count, "cue string, kind int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in range(2 * FOLDS)]
    folds = counted.groupBy("cue").agg(F.array(*sums[1::2]).alias("toxic"), F.array(*sums[::2]).alias("clean"))
    toxic = F.aggregate("toxic", F.lit(0).cast("long"), lambda a, v: a + v)
    return folds.where(toxic >= LEAST_DOCUMENTS).toArrow()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Cues and clause weights; None unless both labels occur."""
    sample = training_documents(docs, labels, rows)
    sizes = np.zeros((2, FOLDS), np.int64)
    for r in sample.groupBy("toxic", "fold").count().collect():
        sizes[r.toxic, r.fold] = r["count"]
    if not sizes.sum(axis=1).all():
        return None
    table = cue_counts(sample)
    cues = table.column("cue").to_pylist()
    toxic, clean = (np.array(table.column(c).to_pylist(), np.int64).reshape(-1, FOLDS) for c in ("toxic", "clean"))

    def from_folds(folds: list[int]) -> Cues:
        return learned(cues, toxic[:, folds].sum(axis=1), clean[:, folds].sum(axis=1), *(int(sizes[k, folds].sum()) for k in (1, 0)))

    # the figures of a training document come from the cues of the other folds
    others = [from_folds([f for f in range(FOLDS) if f != left]) for left in range(FOLDS)]
    machine = grammar()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = figures(batch, others, batch.column("fold").to_numpy(), machine)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c) for c in x.T]], ["toxic", *FIGURES])

    x = sample.mapInArrow(read, "toxic int, " + ", ".join(f"{c} double" for c in FIGURES)).toArrow()
    y = x.column("toxic").to_numpy().astype(float)
    return Model(from_folds(list(range(FOLDS))), *logistic(np.column_stack([x.column(c).to_numpy() for c in FIGURES]), y))


def toxicity_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` and the figures of its clauses, for every row."""
    machine, cues = grammar(), model.cues if model else Cues()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            x = figures(part, [cues], np.zeros(part.num_rows, int), machine)
            chance = model.probability(x) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(chance), *[pa.array(c) for c in x.T]], ["doc_id", "score", *FIGURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, " + ", ".join(f"{c} double" for c in FIGURES))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity_scores(docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
