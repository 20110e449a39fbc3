"""Toxicity by a weighted finite-state pattern grammar whose lexica and weights are learned from labels.

The lexicon maps every word to weighted symbols: insult, threat, target (second person), negation, report, or none. A word of
several lexica gives several, so a clause is a lattice. Three weighted transducers read it and are composed into one:

* negation: an insult within ``REACH`` words after a negation becomes a negated one, a threat becomes nothing;
* report: after a verb of saying, an insult becomes a reported one, a threat becomes nothing;
* target: a clause that holds a target, before or after, turns insults into aimed ones and threats into threats; that
  reading has the better weight; without a target insults are plain and threats are nothing.

The best path through lattice and composition gives the matched classes of each clause; marks end clauses. The weights of a
text's matches, summed by class, and whether there is any insult go into a logistic function, whose weights keep the signs that the grammar gives
them: an insult may lose by being negated or reported, never gain. A text is scored by its
matched clauses: words outside of them never count.

All five lexica are learned, the four smaller ones on top of closed-class words of four languages. Insults are stems and words that
toxic training texts hold far more often (G-test of document counts); threats are words that do so only in clauses with a
target; negations (just before) and reports (anywhere before) are words around insults that mark clean texts; targets are words
around insults that mark toxic ones. Where the labels show no such effect, nothing is added.

Training sees at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows (those with the smallest key hashes), never a row that
``held_out`` marks, and only texts and labels; of near copies in this sample one row counts.

Defined cases: null and empty texts have no match and get the score of a text without matches; without labels of both
kinds nothing is learned and every score is 0; labels without documents, null labels and null keys are not used;
repeated rows get equal scores; other columns stay (one named ``score`` gives way to it).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import dropped, written
from .transducers import Transducer

MAX_TOXIC, MAX_CLEAN = 3_000, 7_000  # labelled rows that training reads at most
SKETCHES = 4  # least shingle hashes by which the sample loses its copies
SALTS = np.arange(1, SKETCHES + 1, dtype=np.uint64) * words.MULT[0]
STEM = range(4, 9)  # letters of a stem
LEAST_ODDS = math.log(8)
#: Closed-class words of the four languages.
THREATS = "kill hurt destroy burn shoot stab tuer frapper brûler töten schlagen umbringen matar golpear quemar"
TARGETS = "you your yours yourself tu toi te vous votre vos du dich dir dein deine euch usted ustedes tú ti vosotros"
NEGATIONS = "not no never neither nor ne pas jamais nicht kein keine nie nunca jamás"
REPORTS = "said says say called calls quoted reported dit disait appelle sagte sagt nannte dijo dice llamó"
MARKS = '.!?;:\n"«»“”'
TOKEN = re.compile(rf"[^\W\d_]+|[{re.escape(MARKS)}]")
REACH = 3  # words that a negation covers
CLASSES = ("plain", "aimed", "negated", "reported", "threat")
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = "none", "insult", "threat", "target", "negation", "report"


def _passing(symbols: list[str], **changed: tuple[str, float, object]) -> Callable[[object], dict[str, list]]:
    return lambda state: {x: [changed.get(x, (x, 0.0, state))] for x in symbols}


def negating() -> Transducer:
    """State: words that the last negation still covers."""
    arcs = {}
    for left in range(REACH + 1):
        after, covered = max(0, left - 1), left > 0
        arcs[left] = {
            NONE: [(NONE, 0.0, after)], TARGET: [(TARGET, 0.0, after)], REPORT: [(REPORT, 0.0, after)], NEGATION: [(NONE, 0.0, REACH)],
            INSULT: [("negated" if covered else INSULT, 0.0, after)], THREAT: [(NONE if covered else THREAT, 0.0, after)],
        }
    return Transducer({0: 0.0}, dict.fromkeys(arcs, 0.0), arcs)


def reporting() -> Transducer:
    """State: whether a verb of saying was read."""
    kept = [NONE, TARGET, INSULT, THREAT, "negated"]
    arcs = {said: _passing(kept, **({INSULT: ("reported", 0.0, 1), THREAT: (NONE, 0.0, 1)} if said else {}))(said) | {REPORT: [(NONE, 0.0, 1)]} for said in (0, 1)}
    return Transducer({0: 0.0}, {0: 0.0, 1: 0.0}, arcs)


def aiming() -> Transducer:
    """Guesses at the start whether the clause has a target; the guess that it has must come true and is then the better one."""
    kept = {NONE: NONE, "negated": "negated", "reported": "reported"}
    arcs = {
        "plain": {x: [(y, 0.0, "plain")] for x, y in {**kept, INSULT: "plain", THREAT: NONE, TARGET: NONE}.items()},
        "hopes": {x: [(y, 0.0, "hopes")] for x, y in {**kept, INSULT: "aimed", THREAT: "threat"}.items()} | {TARGET: [(NONE, 0.0, "aimed")]},
        "aimed": {x: [(y, 0.0, "aimed")] for x, y in {**kept, INSULT: "aimed", THREAT: "threat", TARGET: NONE}.items()},
    }
    return Transducer({"plain": 0.0, "hopes": 0.0}, {"plain": 0.0, "aimed": 1.0}, arcs)


CLAUSE = negating().then(reporting()).then(aiming()).numbered()
#: For comparison: every insult is plain, whatever its clause.
BARE = Transducer({0: 0.0}, {0: 0.0}, {0: {x: [("plain" if x == INSULT else NONE, 0.0, 0)] for x in (NONE, INSULT, THREAT, TARGET, NEGATION, REPORT)}})
SEEDS = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
#: A word's symbols, whether one of them may match, whether the word ends a clause.
Entry = tuple[tuple[tuple[str, float], ...], bool, bool]
PLAIN_WORD: Entry = (((NONE, 0.0),), False, False)
CLAUSE_END: Entry = ((), False, True)


@dataclass
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)  # insults: "abc" matches words that begin so, "abc$" the word itself
    others: dict[str, dict[str, float]] = field(default_factory=lambda: {kind: dict.fromkeys(row.split(), 1.0) for kind, row in SEEDS.items()})
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(CLASSES) + 2))
    by_clause: bool = True

    def entry(self, word: str) -> Entry:
        """The lexicon's output for one word or mark; of insult stems the longest wins."""
        if word in MARKS:
            return CLAUSE_END
        weight = self.stems.get(word + "$")
        if weight is None:
            weight = next((self.stems[word[:k]] for k in range(min(len(word), STEM.stop - 1), STEM.start - 1, -1) if word[:k] in self.stems), None)
        symbols = tuple((kind, known[word]) for kind, known in self.others.items() if word in known)
        if weight is not None:
            symbols = ((INSULT, weight), *symbols)
        return (symbols, symbols[0][0] in (INSULT, THREAT), False) if symbols else PLAIN_WORD


class Entries(dict):
    """Word -> entry, remembered; bounded."""

    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str) -> Entry:
        if len(self) > 300_000:
            self.clear()
        out = self.grammar.entry(word)
        if len(word) <= 40:
            self[word] = out
        return out


def clauses(text: str, entries: Entries) -> Iterator[tuple[list[str], list[Entry]]]:
    """Words and entries of every clause that may hold a match."""
    tokens = TOKEN.findall(text.lower())
    row = [entries[t] for t in tokens]
    begin, may = 0, False
    for i, (_, match, end) in enumerate([*row, CLAUSE_END]):
        may = may or match
        if end:
            if may:
                yield tokens[begin:i], row[begin:i]
            begin, may = i + 1, False


def matches(text: str | None, entries: Entries) -> list[float] | None:
    """Weights of a text's matches summed by class; None if no insult or threat is in it."""
    if not text:
        return None
    machine = CLAUSE if entries.grammar.by_clause else BARE
    sums = None
    for _, row in clauses(text, entries):
        sums = sums or [0.0] * len(CLASSES)
        for out, weight in machine.best([symbols for symbols, _, _ in row]):
            if out != NONE:
                sums[CLASSES.index(out)] += weight
    return sums


def features(sums: list[float] | None) -> np.ndarray:
    """All insults together, whatever their clause; what an insult gains or loses by being aimed, negated or reported; threats; any insult; one."""
    x = np.zeros(len(CLASSES) + 2)
    x[-1] = 1.0
    if sums is not None:
        insults = sum(sums[:4])
        x[: len(CLASSES)] = np.log1p([insults, *sums[1:]])
        x[-2] = float(insults > 0)
    return x


#: What a weight may be: insults, aimed ones and threats never speak for a clean text, and an insult never says more for being negated or reported.
SIGNS = np.array([1, 1, -1, -1, 1, 0, 0])


def held_out(key: str) -> Column:
    """Rows that training never sees: crc32 of the key as text leaves 1 modulo 3."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample without near copies, whose shared words would count as often as they were copied: a row stays if it has the smallest key for each of its least shingle hashes."""
    least = [f"least{k}" for k in range(SKETCHES)]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def compute(column: pa.Array) -> list[pa.Array]:
            raw, at = words.text_bytes(column)
            starts, ends, first = words.word_spans(words.LOWER[raw], at)
            hashes = words.word_hashes(words.LOWER[raw], starts, ends)
            rows = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                found = words.shingles(hashes[a:b], 3)
                rows.append([words.mix(found ^ SALTS[k]).min() if len(found) else np.uint64(k) for k in range(SKETCHES)])
            return [pa.array(c.astype(np.int64)) for c in np.array(rows, np.uint64).reshape(-1, SKETCHES).view(np.int64).T]

        return compute

    sketched = written(words.appended(sample, dict.fromkeys(least, "long"), make, carry=["key", "text", "toxic"]), "sketched")
    kept = sketched
    for c in least:  # a bounded sample: so are its tables of hashes
        kept = kept.join(F.broadcast(sketched.groupBy(c).agg(F.min("key").alias(f"{c}_first"))), c)
    return kept.filter(" and ".join(f"key = {c}_first" for c in least)).select("text", "toxic")


def _counts(sample: DataFrame, found: Callable[[str], Iterator[tuple[str, str]]]) -> DataFrame:
    """kind, word, toxic, clean: documents with each (kind, word) that ``found`` gives for their texts, summed in every task first."""
    schema = pa.schema([("kind", pa.string()), ("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[1 - toxic].update(set(found(text or "")))
        keys = list(counts[0].keys() | counts[1].keys())
        rows = ([k for k, _ in keys], [w for _, w in keys], [counts[0][k] for k in keys], [counts[1][k] for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    return sample.select("text", "toxic").mapInArrow(run, "kind string, word string, toxic long, clean long").groupBy("kind", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _stems_and_aimed(text: str) -> Iterator[tuple[str, str]]:
    """("any", word$ or stem), ("aimed", "") of texts with a target, ("aimed", word) for words in a clause with one."""
    targets = set(TARGETS.split())
    tokens = TOKEN.findall(text.lower())
    for w in set(tokens):
        if len(w) >= 3:
            yield "any", w + "$"
            yield from (("any", w[:k]) for k in STEM if k <= len(w))
    begin = 0
    for i, t in enumerate([*tokens, MARKS[0]]):
        if t in MARKS:
            clause = set(tokens[begin:i])
            if clause & targets:
                yield "aimed", ""
                yield from (("aimed", w) for w in clause - targets)
            begin = i + 1


def _around(grammar: Grammar) -> Callable[[str], Iterator[tuple[str, str]]]:
    """("hits", ""), ("near", word) just before an insult, ("before", word) and ("clause", word) of clauses with an insult."""
    entries = Entries(grammar)

    def found(text: str) -> Iterator[tuple[str, str]]:
        for tokens, row in clauses(text, entries):
            at = [i for i, (symbols, _, _) in enumerate(row) if symbols[0][0] == INSULT]
            if at:
                yield "hits", ""
                yield from (("near", tokens[j]) for i in at for j in range(max(0, i - REACH), i))
                yield from (("before", w) for w in tokens[: at[-1]])
                yield from (("clause", w) for j, w in enumerate(tokens) if j not in at)

    return found


def _marking(counts: DataFrame, kind: str, of: tuple[str, str], sizes: tuple[int, int], margin: float = 4) -> list[tuple[str, float, int]]:
    """word, log odds, documents: words of a kind that documents of the first side hold far more often than chance allows, the surest first.

    The best of n words without an effect has a G of about 2 ln n, which ``margin`` is added to.
    """
    first, second = sizes
    if not first or not second:
        return []
    a, b = F.col(of[0]).cast("double"), F.col(of[1]).cast("double")
    share = first / (first + second)
    g = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * share))).otherwise(0.0) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (first + 1)) - F.log((b + 0.5) / (second + 1))
    some = counts.filter((F.col("kind") == kind) & (F.col("word") != ""))
    bar = 2 * math.log(max(2, some.count())) + margin
    rows = some.withColumns({"g": g, "odds": odds}).filter((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= bar) & (a >= 3))
    return [(r["word"], min(4.0, r["odds"]), r[of[0]]) for r in rows.orderBy(F.desc("g"), F.length("word").desc(), "word").collect()]  # words of the bounded sample


def _insults(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    out: dict[str, float] = {}
    docs: dict[str, int] = {}
    stems: dict[str, set[str]] = {}  # chosen ones by each of their own beginnings
    # A margin below 0 lets in a handful of chance stems (e^2), to find those of small training sets too. A word brings up to six stems.
    for s, odds, n in _marking(counts, "any", ("toxic", "clean"), (toxic, clean), margin=-4):
        word = s.rstrip("$")
        shorter = [word[:k] for k in STEM if k < len(s)]
        # A stem whose documents a chosen one explains adds nothing; the longer of equal stems says more exactly what it is.
        if any(q in out for q in shorter) or any(docs[q] >= 0.95 * n for q in stems.get(word, ()) if q != s):
            continue
        out[s], docs[s] = odds, n
        for k in range(1, len(word) + 1):
            stems.setdefault(word[:k], set()).add(s)
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression with balanced classes by Newton steps, with the signs of ``SIGNS``: a weight that wants the other one is 0, and the rest is fitted anew."""
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[free] = _newton(x[:, free], y, rounds, ridge)
        wrong = w * SIGNS < -1e-9
        if not wrong.any():
            return w
        free &= ~wrong


def _newton(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic", by_clause: bool = True) -> Grammar:
    """A grammar from labelled documents outside the held-out third; without ``by_clause`` all insults are plain ones."""
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(toxic).cast("int").alias("toxic")).filter("key is not null and toxic in (0, 1)").filter(~held_out("key")).distinct()
    chosen = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("key"), "key").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    pick = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two limits
    picked = written(docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).join(pick, "key"), "picked")
    sample = written(_one_of_copies(picked), "labelled")
    dropped(picked)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grammar = Grammar(by_clause=by_clause)
    if len(size) == 2:
        sides = ("toxic", "clean"), ("clean", "toxic")
        counts = written(_counts(sample, _stems_and_aimed), "counts")
        grammar.stems = _insults(counts, size[1], size[0])
        alone = {w.rstrip("$") for w in grammar.stems}
        aimed = counts.filter("kind = 'aimed' and word = ''").first() or {"toxic": 0, "clean": 0}
        grammar.others[THREAT] |= {w: 1.0 for w, _, _ in _marking(counts, "aimed", sides[0], (aimed["toxic"], aimed["clean"])) if not any(w[:k] in alone for k in range(3, len(w) + 1))}
        near = written(_counts(sample, _around(grammar)), "around")
        hits = near.filter("kind = 'hits'").first()
        if hits:
            clean_hits = (hits["clean"], hits["toxic"])
            negations = {w: odds for w, odds, _ in _marking(near, "near", sides[1], clean_hits)}
            grammar.others[NEGATION] |= negations
            grammar.others[REPORT] |= {w: odds for w, odds, _ in _marking(near, "before", sides[1], clean_hits) if w not in negations}
            grammar.others[TARGET] |= {w: odds for w, odds, _ in _marking(near, "clause", sides[0], clean_hits[::-1])}
        dropped(counts)
        dropped(near)
        grammar.weights = _fitted(sample, grammar)
    dropped(sample)
    return grammar


def _fitted(sample: DataFrame, grammar: Grammar) -> list[float]:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        entries = Entries(grammar)

        def compute(column: pa.Array) -> list[pa.Array]:
            sums = [matches(t, entries) for t in column.to_pylist()]
            rows = np.array([[-1.0] * len(CLASSES) if s is None else s for s in sums]).reshape(-1, len(CLASSES))
            return [pa.array(np.ascontiguousarray(c)) for c in rows.T]

        return compute

    got = words.appended(sample, dict.fromkeys(CLASSES, "double"), make, carry=["toxic"]).collect()  # numbers of the bounded sample
    x = np.array([features(None if r["plain"] < 0 else [r[c] for c in CLASSES]) for r in got])
    return _fit(x, np.array([float(r["toxic"]) for r in got])).tolist()


def score(docs: DataFrame, grammar: Grammar, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``score``, 0 to 1: how likely the text is toxic."""
    trained = any(grammar.weights)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        entries, w = Entries(grammar), np.array(grammar.weights)

        def one(sums: list[float] | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(features(sums) @ w, -30, 30)))) if trained else 0.0

        clean = one(None)

        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([clean if s is None else one(s) for s in (matches(t, entries) for t in column.to_pylist())], pa.float64())]

        return compute

    return words.appended(docs, {"score": "double"}, make, text=text, carry=carry)
