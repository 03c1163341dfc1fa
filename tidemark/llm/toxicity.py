"""Toxicity as a weighted finite-state pattern grammar.

Machines are tables of arcs (state, symbol) to (state, symbol), composed into one:

* Lexicon (letters to symbols): a trie reads a word and emits its class with a weight: INSULT (stems learned from
  labels, the weight is the stem's log odds), THREAT (stems), TARGET, NEGATION, REPORT (whole words). A stem covers
  its inflections.
* Negation rewrites threats and insults in its scope into denied ones; reported speech and target remember that
  they occurred anywhere in the clause; insult remembers the strongest reading, and a negation shortly after an
  insult denies it too; threat remembers one that stands.

Their composition reads the symbols of one clause. Its final state says which arc the clause takes (plain,
aimed, negated or reported insult, aimed threat), and the clause scores the greatest weight of its insults. So
matched clauses are scored, never isolated words: ten insults in one clause weigh what its best one weighs, and a
negated or reported one counts for an arc of its own. Document features are logarithms of sums over all clauses;
their weights are a ridge regression on the labels towards ``PRIOR``, so an arc without evidence keeps its prior
weight.

Learning reads at most ``SAMPLE`` labelled documents, those with the smallest hashes of their id; stems and
statistics come from all words of these, which bounds them too. Scoring covers every whole text.

Defined results: null or empty text: the score of a text without matches; no usable label: the prior grammar
without learned stems; ties and repeated rows: scored alike; null id: scored, never held out; an empty table: no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import tidy

SAMPLE = 20_000
SHORTEST, LONGEST = 4, 9  # letters of a stem; a word of three letters is a stem of its own
EVIDENCE = 28.0  # log-likelihood ratio a stem needs, about one chance in 10^7
ODDS = 2.5
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|]")
ENDS = frozenset(".!?;:\n|")
FEATURES = ("one", "plain", "aimed", "negated", "reported", "threat", "clauses")
PRIOR = np.array([-4.0, 3.0, 3.6, 0.7, 0.7, 3.0, 0.7])
MAX_WORDS = 100_000

# Fixed word lists of the grammar, English, German, French, Spanish.
TARGETS = frozenset("you your yours youre u du dich dir dein deine ihr euch euer tu toi ton ta tes vous votre vos ti tus usted ustedes".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn without nicht kein keine keinen nie niemals pas jamais ni nunca sin".split())
REPORTS = frozenset("said says say called calls quoted wrote told claims sagte sagt nannte schrieb dit disait appelle traite dijo dice llama".split())
THREATS = frozenset("kill murder hurt destroy strangl töte umbring vernicht tuer détrui frapp matar destru golpe".split())

OTHER, NEGATION, REPORT, TARGET, THREAT, INSULT, DENIED_THREAT, DENIED_INSULT = range(8)
Arcs = dict[tuple[int, int], tuple[int, int]]
SCOPE, AFTER = 4, 2


def machine(states: Iterable[int], symbols: Iterable[int], rule: Callable[[int, int], tuple[int, int]]) -> Arcs:
    """A complete deterministic transducer from its arc rule; 0 is the start."""
    symbols = list(symbols)
    return {(s, x): rule(s, x) for s in states for x in symbols}


def _insulting(s: int, x: int) -> int:
    """0: none, 1: denied, 2: standing, 2 + k: standing, and a negation in the next k words denies it."""
    if x == INSULT:
        return 2 if s == 2 else 2 + AFTER
    if x == DENIED_INSULT:
        return s or 1
    if x == NEGATION and s > 2:
        return 1
    return s - 1 if s > 2 else s


NEGATING = machine(range(SCOPE + 1), range(6), lambda s, x: (SCOPE if x == NEGATION else max(0, s - 1), {THREAT: DENIED_THREAT, INSULT: DENIED_INSULT}.get(x, x) if s else x))
REPORTING = machine(range(2), range(8), lambda s, x: (int(s or x == REPORT), x))
AIMING = machine(range(2), range(8), lambda s, x: (int(s or x == TARGET), x))
INSULTING = machine(range(3 + AFTER), range(8), lambda s, x: (_insulting(s, x), x))
THREATENING = machine(range(2), range(8), lambda s, x: (int(s or x == THREAT), x))
PARTS = (NEGATING, REPORTING, AIMING, INSULTING, THREATENING)


def arc_of(parts: tuple[int, ...]) -> tuple[int, int]:
    """What a clause that ends in these states of ``PARTS`` counts for: (feature, aimed threat)."""
    _, reported, aimed, insulted, threat = parts
    kind = 0 if not insulted else 3 if insulted == 1 else 4 if reported else 2 if aimed else 1
    return kind, int(threat and aimed)


def composed(parts: tuple[Arcs, ...]) -> tuple[dict[int, int], list[tuple[int, ...]]]:
    """The composition of machines in a row, as far as it can be reached: arcs (state << 3 | symbol to state) and the
    parts' states behind each state."""
    first = (0,) * len(parts)
    number, names, arcs = {first: 0}, [first], {}
    for state in names:  # grows while it is read
        for symbol in range(6):
            x, to = symbol, []
            for part, s in zip(parts, state, strict=True):
                s, x = part[s, x]
                to.append(s)
            if (to := tuple(to)) not in number:
                number[to] = len(names)
                names.append(to)
            arcs[number[state] << 3 | symbol] = number[to]
    return arcs, names


CLAUSE, _NAMES = composed(PARTS)
FINAL = [arc_of(x) for x in _NAMES]


@dataclass
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self.begins = frozenset(s[:SHORTEST] for s in self.stems) | frozenset(w[:SHORTEST] for w in THREATS)
        self.trie = self._lexicon()
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _lexicon(self) -> dict:
        """The trie: letter to node; "" to what is emitted at any continuation, "$" to what only a whole word emits."""
        root: dict = {}
        for names, symbol, mark in ((TARGETS, TARGET, "$"), (NEGATIONS, NEGATION, "$"), (REPORTS, REPORT, "$"), (THREATS, THREAT, ""), (self.stems, INSULT, "")):
            for name in names:
                node = root
                for letter in name:
                    node = node.setdefault(letter, {})
                node["$" if symbol == INSULT and len(name) < SHORTEST else mark] = (symbol, self.stems[name] if symbol == INSULT else 0.0)
        return root

    def emit(self, word: str) -> tuple[int, float]:
        """The lexicon's symbol and weight for a word: a whole word's if there is one, else those of its shortest stem."""
        if (out := self.known.get(word)) is None:
            node, out = self.trie, (OTHER, 0.0)
            for letter in word:
                if (node := node.get(letter)) is None:
                    break
                if out[0] == OTHER and "" in node:
                    out = node[""]
            if node is not None and "$" in node:
                out = node["$"]
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def clause(self, tokens: list[str]) -> tuple[int, int, float]:
        """(feature, aimed threat, weight) of a clause; feature 0 without an insult."""
        state, weight, emit = 0, 0.0, self.emit
        for t in tokens:
            symbol, w = emit(t)
            state = CLAUSE[state << 3 | symbol]
            if w > weight:
                weight = w
        return *FINAL[state], weight

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if text:
            tokens, begins = TOKEN.findall(text.lower()), self.begins
            done = -1
            for k, t in enumerate(tokens):
                if t[:SHORTEST] in begins and k > done and self.emit(t)[0] >= THREAT:
                    low = k
                    while low and tokens[low - 1] not in ENDS:
                        low -= 1
                    done = k
                    while done + 1 < len(tokens) and tokens[done + 1] not in ENDS:
                        done += 1
                    kind, threat, weight = self.clause(tokens[low : done + 1])
                    if kind:
                        out[kind] += weight / 5
                    out[5] += threat
                    out[6] += bool(kind or threat)
        out = np.log1p(out)
        out[0] = 1.0
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -50, 50)))


def held_out(id: Column) -> Column:
    """Whether a row belongs to the held-out quarter; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _stems_of(word: str) -> list[str]:
    """The stems a word may have: its beginnings, or itself if it has three letters."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] if len(word) >= SHORTEST else [word] if len(word) == SHORTEST - 1 else []


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            toxic, clean = Counter(), Counter()
            for text, y in zip(part.column("text"), part.column("toxic").to_pylist(), strict=True):
                words = set(TOKEN.findall((text.as_py() or "").lower()))
                (toxic if y else clean).update({s for w in words for s in _stems_of(w)})
            stems = list(toxic.keys() | clean.keys())
            yield pa.record_batch([pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()), pa.array([clean[s] for s in stems], pa.int64())], names=["stem", "a", "b"])


def _contexts(stems: set[str]):
    """Occurrences of stems with a hash of both neighbours: copies of a text repeat a context, uses of a word don't."""
    begins = {s[:SHORTEST] for s in stems}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                words = ["", *TOKEN.findall((text.as_py() or "").lower()), ""]
                for k, w in enumerate(words):
                    if w[:SHORTEST] in begins:
                        context = None
                        for s in _stems_of(w):
                            if s in stems:
                                context = context or zlib.crc32(f"{words[k - 1]} {words[k + 1]}".encode())
                                rows.add((s, context, y))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["stem", "context", "toxic"])

    return work


def _told(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Stems with counts (a, b) that the base rate does not explain, with their log odds ``weight``."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    base, n = toxic / (toxic + clean), F.col("a") + F.col("b")
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (term(a, n * base) + term(b, n * (1 - base)))
    weight = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    return counts.withColumn("weight", weight).where((ratio >= EVIDENCE) & (F.col("weight") > ODDS)).select("stem", "weight")


def _regressed(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression on ``n`` cases a row with a ridge towards ``PRIOR``, by Newton steps."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn the insult stems and the weights of the arcs. Rows with ``held_out`` ids are never read."""
    taken = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    taken = taken.orderBy(F.xxhash64("doc_id"), "toxic").limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic")  # SAMPLE rows at most
    totals = {int(r[0] > 0): r[1] for r in sample.groupBy(F.when(F.col("toxic") > 0, 1).otherwise(0)).count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Grammar()
    counts = sample.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(tidy(_stem_counts), "stem string, a long, b long")
    counts = counts.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    likely = {r.stem for r in _told(counts.where("a > b"), toxic, clean).collect()}  # of SAMPLE documents' words
    found = sample.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(tidy(_contexts(likely)), "stem string, context long, toxic boolean")
    found = found.groupBy("stem", "context").agg(F.max("toxic").alias("toxic")).groupBy("stem").agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.sum((~F.col("toxic")).cast("int")).alias("b"))
    good = {r.stem: r.weight for r in _told(found, toxic, clean).collect()}
    stems: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):  # the shortest stem stands for its continuations
        if not any(s[:n] in stems for n in range(SHORTEST, len(s))):
            stems[s] = good[s]
    grammar = Grammar(stems)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter((*grammar.features(t.as_py()).tolist(), y) for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True))
            yield pa.record_batch([pa.array([list(k[:-1]) for k in seen], pa.list_(pa.float64())), pa.array([float(k[-1] > 0) for k in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["x", "y", "n"])

    rows = sample.mapInArrow(work, "x array<double>, y double, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()  # SAMPLE rows at most
    x, y, n = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.n for r in rows], float)
    grammar.weights = _regressed(x, y, n)
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows with ``score`` (0 to 1) and ``predicted``, in one narrow pass."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([grammar.features(t.as_py()) for t in b.column(text)]).reshape(b.num_rows, len(FEATURES))
            s = grammar.scores(x)
            yield pa.record_batch([*[b.column(f.name) for f in kept], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*[f.name for f in kept], "score", "predicted"])

    return docs.mapInArrow(tidy(work), schema)
