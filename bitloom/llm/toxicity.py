"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (another word, a learned insult of level 1 to 3, a threat, a target, a negation, a report), and five
letter-to-letter transducers, each a table of states and arcs, rewrite a clause's symbols in turn:

* negation marks insults and threats within three words after it
* reported speech marks those that follow it in the clause
* target marks those within three words after a word that addresses or names somebody
* insult turns insults into weighted events (plain, aimed, negated, reported), and a target within three words after a plain
  one into the event that aims it
* threat turns threats into events, when a target lies within three words before or after

``compose`` makes one machine of the five. Its events are summed for each clause; the document's features are sums over
its clauses and the heaviest clause. The events' weights come from a logistic regression on labelled rows that starts at
stated weights (``PRIOR``), which stand where the labelled rows hold no such event; negated and reported events never
raise a score, the others never lower it.

Insults are learned on labelled rows too: a stem or word counts when clearly more of its places are in rows labelled 1 than
their share of the text explains, in each of two halves of the texts. Of texts that begin alike one counts, and in a text a
word counts once after each different word, which keeps copies and repetitions from teaching their own vocabulary.
Learning reads a sample of at most ``sample_rows``
labelled rows, chosen by hash; scoring reads every whole text.

Defined results: null and empty texts get the score of a text without matches. Rows labelled null and rows that the
fold holds out are not learned from; of repeated labels for one id the larger counts. Without labelled rows of both
classes the score is the smoothed share of label 1 (0.5 without any row, then predicted is 0 all the same).
Repeated rows get repeated scores, an empty table an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SAMPLE_ROWS = 12_000
FOLDS = 5
#: Words whose symbol a task remembers, longer ones never; then it starts anew.
REMEMBERED_WORDS, REMEMBERED_LENGTH = 100_000, 64
STEM_LENGTHS = (4, 5, 6, 7)
#: Texts with the same first characters teach stems once, in the half that these deal them to.
HEAD_CHARS = 24
#: A stem needs so many places in toxic texts of each half, so many standard deviations above its share, and odds
#: e^MIN_WEIGHT times the base rate's.
MIN_PLACES, SIGMAS, MIN_WEIGHT = 4, 4.0, 1.5

TARGETS = frozenset(
    "you your yours u ya he she they him her them his their this that these those everyone everybody people du dich dir dein "
    "deine ihr euch sie er es ihm ihn ihnen dieser diese dieses tu toi te vous il elle ils elles lui leur ce cet cette ces tú ti "
    "te usted ustedes él ella ellos ellas este esta ese esa vosotros".split()
)
THREATS = frozenset(
    "kill kills murder hurt destroy crush beat burn shoot stab strangle töte töten umbringen ermorden schlagen verletzen "
    "vernichten erschießen tuer tuerai frapper blesser détruire brûler étrangler matar mataré golpear herir destruir quemar".split()
)
NEGATIONS = frozenset(
    "not no never nobody neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine keinen "
    "nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split()
)
REPORTS = frozenset(
    "said says say told tells wrote writes claimed claims quoted called sagte sagt schrieb behauptete nannte dit disait écrit "
    "affirmait appelait dijo dice escribió afirmó llamó".split()
)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: How many words a negation or a target reaches.
REACH = 3
LEVELS = (1, 2, 3)
OTHER, TARGET, NEGATION, REPORT, THREAT = "w", "g", "n", "r", "t"
INSULTS = tuple(f"i{k}" for k in LEVELS)
ALPHABET = (OTHER, TARGET, NEGATION, REPORT, THREAT, *INSULTS)
EVENTS = ("plain", "aimed", "negated", "reported", "threat")
#: Features: the five events (log of 1 + sum of weights), heaviest clause, any straight event, length (log of 1 + words),
#: weight per word; then the weights the regression starts from, and the sign that a weight may have.
N_FEATURES = 9
PRIOR = (1.0, 1.5, -0.5, -0.5, 4.0, 0.5, 0.5, 0.0, 0.5)
SIGNS = (1, 1, -1, -1, 1, 1, 1, 0, 1)


@dataclass(frozen=True)
class Transducer:
    """A letter-to-letter machine: ``arcs`` leads from (state, symbol) to (next state, written symbol)."""

    start: object
    arcs: dict

    def run(self, symbols: list[str]) -> list[str]:
        state, written = self.start, []
        for symbol in symbols:
            state, out = self.arcs[state, symbol]
            written.append(out)
        return written


def _machine(start: object, alphabet: set[str], step: Callable) -> Transducer:
    """All arcs that can be reached from ``start`` when ``step`` says where each leads."""
    arcs, open_states = {}, [start]
    while open_states:
        state = open_states.pop()
        for symbol in sorted(alphabet):
            if (state, symbol) not in arcs:
                arcs[state, symbol] = step(state, symbol)
                open_states.append(arcs[state, symbol][0])
    return Transducer(start, arcs)


def _written(machine: Transducer) -> set[str]:
    return {out for _, out in machine.arcs.values()}


def grammar_machines() -> list[Transducer]:
    """Negation, reported speech, target, insult, threat; each reads what the one before writes."""
    hurting = lambda x: x[0] in "it"

    def negation(left: int, x: str) -> tuple[int, str]:
        out = x + "-" if left and hurting(x) else x
        return (REACH if x == NEGATION else max(0, left - 1)), out

    def report(said: bool, x: str) -> tuple[bool, str]:
        return said or x == REPORT, x.rstrip("-") + "~" if said and hurting(x) else x

    def target(left: int, x: str) -> tuple[int, str]:
        out = x + "+" if left and hurting(x) and x[-1] not in "-~" else x
        return (REACH if x == TARGET else max(0, left - 1)), out

    def insult(state: tuple[int, int], x: str) -> tuple[tuple[int, int], str]:
        level, left = state
        rest = (level, left - 1) if left > 1 else (0, 0)
        if x[0] == "i":
            kind = {"+": "aimed", "-": "negated", "~": "reported"}.get(x[-1], "plain")
            return ((int(x[1]), REACH) if kind == "plain" else rest), f"{kind}{x[1]}"
        return ((0, 0), f"g aims{level}") if x == TARGET and level else (rest, x)

    def threat(left: int, x: str) -> tuple[int, str]:
        if x[0] == "t":
            kind = {"+": "threat3", "-": "negated1", "~": "reported1"}.get(x[-1], OTHER)
            return (REACH if kind == OTHER else max(0, left - 1)), kind
        if x[0] == "g" and left:
            return 0, x + " threat3"
        return max(0, left - 1), x

    machines, alphabet = [], set(ALPHABET)
    for start, step in ((0, negation), (False, report), (0, target), ((0, 0), insult), (0, threat)):
        machines.append(_machine(start, alphabet, step))
        alphabet = _written(machines[-1])
    return machines


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """The machine that writes what ``second`` makes of what ``first`` writes."""

    def step(state: tuple, symbol: str) -> tuple[tuple, str]:
        one, between = first.arcs[state[0], symbol]
        two, out = second.arcs[state[1], between]
        return (one, two), out

    return _machine((first.start, second.start), alphabet, step)


def event_weights(written: str) -> np.ndarray:
    """What a written symbol adds to each of ``EVENTS``."""
    total = np.zeros(len(EVENTS))
    for part in written.split():
        name, level = part[:-1], part[-1]
        if name == "aims":  # a plain event turns out to be aimed
            total[0] -= int(level)
            total[1] += int(level)
        elif name in EVENTS:
            total[EVENTS.index(name)] += int(level)
    return total


@lru_cache(maxsize=1)
def composed() -> tuple[list[list[int]], list[list[tuple[float, ...] | None]]]:
    """The five machines as one table: next state and weights by state and symbol; state 0 is the start."""
    machine, *rest = grammar_machines()
    for other in rest:
        machine = compose(machine, other, set(ALPHABET))
    number: dict = {machine.start: 0}
    for state, _ in machine.arcs:
        number.setdefault(state, len(number))
    follow = [[0] * len(ALPHABET) for _ in number]
    weights: list[list[tuple[float, ...] | None]] = [[None] * len(ALPHABET) for _ in number]
    for (state, symbol), (after, written) in machine.arcs.items():
        at, k = number[state], ALPHABET.index(symbol)
        follow[at][k] = number[after]
        found = event_weights(written)
        weights[at][k] = tuple(found.tolist()) if found.any() else None
    return follow, weights


class Grammar:
    """The composed transducer. ``stems``: weight by stem; a stem that ends in $ is a whole word."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.known: dict[str, int] = {}
        self.follow, self.weights = composed()

    def _symbol(self, word: str) -> int:
        """Place in ``ALPHABET``."""
        forms = (f"{word}$", *(word[:n] for n in STEM_LENGTHS if n <= len(word)))
        weights = [self.stems[s] for s in forms if s in self.stems]
        if weights:
            return ALPHABET.index(INSULTS[min(len(LEVELS), max(1, round(max(weights) / 2))) - 1])
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return ALPHABET.index(symbol)
        return 0

    def symbols(self, words: list[str]) -> list[int]:
        known = self.known
        for w in words:
            if w not in known and len(w) <= REMEMBERED_LENGTH:
                if len(known) > REMEMBERED_WORDS:
                    known.clear()
                known[w] = self._symbol(w)
        return [known[w] if w in known else self._symbol(w) for w in words]

    def clause(self, symbols: list[int]) -> list[float]:
        """Sums of the events of one clause."""
        state, sums = 0, [0.0] * len(EVENTS)
        for symbol in symbols:
            if (found := self.weights[state][symbol]) is not None:
                sums = [a + b for a, b in zip(sums, found)]
            state = self.follow[state][symbol]
        return sums

    def features(self, text: str) -> list[float]:
        sums, heaviest, n_words, hurting = [0.0] * len(EVENTS), 0.0, 0, ALPHABET.index(THREAT)
        for part in _CLAUSE.split(text.lower()):
            words = _WORD.findall(part)
            n_words += len(words)
            symbols = self.symbols(words)
            if symbols and max(symbols) >= hurting:
                found = self.clause(symbols)
                sums = [a + b for a, b in zip(sums, found)]
                heaviest = max(heaviest, found[0] + found[1] + found[4])
        straight = sums[0] + sums[1] + sums[4]
        density = 100 * straight / (n_words + 50)
        return [*map(math.log1p, sums), heaviest, float(straight > 0), math.log1p(n_words) / 5, math.log1p(density)]


@dataclass
class ToxicityModel:
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    bias: float = 0.0

    def score(self, grammar: Grammar, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, grammar.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def _stems(sample: DataFrame) -> dict[str, float]:
    """Learned stems with their log odds over the base rate. ``sample``: doc_id, toxic, text. Of texts that begin alike, as
    copies do, one is read; what counts is the number of a stem's places in these texts by label and half, the same two words
    once in each text."""
    head = F.lower(F.substring("text", 1, HEAD_CHARS)).alias("head")
    least = F.min(F.struct("doc_id", "toxic", "text")).alias("row")
    half = (F.crc32(F.col("head").cast("binary")) % 2).cast("int").alias("half")
    once = cut(sample.select(head, "doc_id", "toxic", "text").groupBy("head").agg(least).select("row.toxic", half, "row.text"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}'’]+"), lambda w: F.length(w) > 0)
    before = F.concat(F.array(F.lit("")), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    pairs = F.array_distinct(F.zip_with(before, F.col("words"), lambda b, w: F.concat(b, F.lit(" "), w)))
    word = F.substring_index("pair", " ", -1).alias("w")
    placed = once.select("toxic", "half", words.alias("words")).where(F.size("words") > 0).select("toxic", "half", F.explode(pairs).alias("pair"))
    forms = [F.concat("w", F.lit("$")), *[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEM_LENGTHS]]
    held = placed.select("toxic", "half", word).select("toxic", "half", F.explode(F.array(*forms)).alias("stem")).where(F.col("stem").isNotNull())
    counted = lambda y, h: F.count(F.when((F.col("toxic") == y) & (F.col("half") == h), 1))
    seen = held.groupBy("stem").agg(*[counted(y, h).alias(f"n{y}{h}") for y in (1, 0) for h in (0, 1)])
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)

    def odds(n1: Column, n0: Column) -> Column:
        return F.log((n1 + 0.5) / (n0 + 0.5)) - math.log(share / (1 - share))

    clear = F.lit(True)
    for h in (0, 1):
        n1, n0 = F.col(f"n1{h}"), F.col(f"n0{h}")
        spare = n1 - (n1 + n0) * share
        clear = clear & (n1 >= MIN_PLACES) & (spare >= SIGMAS * F.sqrt((n1 + n0) * share * (1 - share))) & (odds(n1, n0) >= MIN_WEIGHT)
    weight = odds(F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01"))
    best = seen.where(clear).select("stem", weight.alias("weight")).collect()  # from the sample: its rows bound them
    found: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["stem"]), r["stem"])):  # a longer form has to tell clearly more than its stem
        shorter = [found[r["stem"][:n]] for n in STEM_LENGTHS if r["stem"][:n] in found]
        if not shorter or r["weight"] > max(shorter) + 1:
            found[r["stem"]] = r["weight"]
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method from ``PRIOR``; a weight of the wrong sign becomes 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    signs, start = np.array([*SIGNS, 0]), np.array([*PRIOR, 0.0])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.where(free, start, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            slope = x.T @ (y - p) - penalty * (w - start)
            move = np.zeros_like(w)
            move[free] = np.linalg.solve(hessian[np.ix_(free, free)], slope[free])
            w += np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-6:
                break
        wrong = free & (w * signs < 0)
        if not wrong.any():
            return w
        free &= ~wrong


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    folds: int = FOLDS,
) -> ToxicityModel:
    """Learns from at most ``sample_rows`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", folds)
    )
    once = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # at most sample_rows ids and labels, 12 bytes each, are broadcast
    sample = cut(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text", "doc_id"))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n = counts.get(1, 0), sum(counts.values())
    prior = math.log((n1 + 0.5) / (n - n1 + 0.5)) if n else 0.0
    if not 0 < n1 < n:
        return ToxicityModel(bias=prior if n else -1e-9)
    stems = _stems(sample)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in source:
            rows = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(batches, "toxic int, x array<double>").collect()  # at most sample_rows short rows
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"] == 1) for r in rows])
    w = _logistic(x, y)
    return ToxicityModel(stems, w[:-1].tolist(), float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every whole text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in source:
            scores = np.array([model.score(grammar, t.as_py()) for t in batch.column(1)], np.float64)
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), predicted], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(batches, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's rows and columns without texts that score ``threshold`` or more; rows never leave their task."""
    at = docs.columns.index(text_col)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in source:
            keep = [model.score(grammar, t.as_py() or "") < threshold for t in batch.column(at)]
            yield pc.filter(batch, pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
