"""Toxicity by a weighted finite-state grammar over clauses, with a learnt lexicon and learnt clause weights."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the weights are learnt from, at most: those of the lowest hashes.
SAMPLE = 12_000
STEMS = range(4, 10)
#: What makes a word or start of words a pattern: toxic rows that hold it, log odds, and log odds times the root of those rows.
SUPPORT, ODDS, EVIDENCE = 5, 2.0, 6.0

# Cue words of the four languages.
THREATS = "kill hurt destroy beat burn shoot stab strangle töten schlagen vernichten verbrennen matar golpear destruir quemar tuer frapper détruire brûler".split()
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch euer tú usted ustedes vosotros te ti tu toi vous votre vos tes".split()
NEGATIONS = "not never isn't aren't wasn't don't doesn't didn't cannot nicht kein keine keinen nie niemals nunca jamás tampoco pas jamais aucun aucune".split()
REPORTS = "said says claimed reported wrote quoted called allegedly sagte behauptete schrieb berichtete angeblich dijo afirmó escribió informó presuntamente déclaré affirmé écrit rapporté prétendument".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.,;:!?\n|]")
#: ASCII that isn't a letter becomes a space, to count words.
FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Output classes of a clause with an insult or a threat.
CLASSES = ("plain", "targeted", "negated", "reported", "threat", "threat_targeted")
FEATURES = 4 + 2 * len(CLASSES)


class Transducer:
    """A deterministic weighted finite-state transducer over cue symbols.

    ``arcs`` lead from (state, symbol) to (state, weight); a symbol without an arc leaves the state as it is at a weight
    of 1. ``tells`` names what a clause is that ends in a state.
    """

    def __init__(self, start: str, arcs: dict[tuple[str, str], tuple[str, float]], tells: dict[str, str]):
        self.start, self.arcs, self.tells = start, arcs, tells

    def step(self, state: str, symbol: str) -> tuple[str, float]:
        return self.arcs.get((state, symbol), (state, 1.0))

    def told(self, state: str) -> frozenset[str]:
        return frozenset(t for t in self.tells.get(state, "").split("+") if t)

    def compose(self, other: "Transducer") -> "Transducer":
        """The machine that runs both over the same symbols: weights of arcs multiply, and states tell what both tell."""
        symbols = {s for _, s in self.arcs} | {s for _, s in other.arcs}
        arcs, tells, open_ = {}, {}, [(self.start, other.start)]
        while open_:
            a, b = open_.pop()
            name = f"{a}+{b}"
            if name in tells:
                continue
            tells[name] = "+".join(sorted(self.told(a) | other.told(b)))
            for s in symbols:
                (x, v), (y, w) = self.step(a, s), other.step(b, s)
                arcs[name, s] = (f"{x}+{y}", v * w)
                open_.append((x, y))
        return Transducer(f"{self.start}+{other.start}", arcs, tells)

    def run(self, symbols: tuple[str, ...]) -> tuple[frozenset[str], tuple[float, ...]]:
        """What the end tells, and the weight of each symbol's arc."""
        state, weights = self.start, []
        for s in symbols:
            state, w = self.step(state, s)
            weights.append(w)
        return self.told(state), tuple(weights)


def machines() -> list[Transducer]:
    """The five machines of the grammar. Symbols: I insult, H threat, T target, N negation, R reported speech.

    Weights bear on the arcs of insults and threats: more after a target, less after a negation or in reported speech.
    A target or a report counts on either side of the insult, a negation only before it.
    """
    return [
        Transducer("clean", {("clean", "I"): ("insult", 1.0)}, {"insult": "insult"}),
        Transducer("calm", {("calm", "H"): ("threat", 1.0)}, {"threat": "threat"}),
        Transducer("nobody", {("nobody", "T"): ("someone", 1.0), ("someone", "I"): ("someone", 1.5), ("someone", "H"): ("someone", 2.0)}, {"someone": "targeted"}),
        Transducer("open", {("open", "N"): ("denied", 1.0), ("open", "I"): ("stands", 1.0), ("open", "H"): ("stands", 1.0), ("denied", "I"): ("denied", 0.4), ("denied", "H"): ("denied", 0.3)}, {"denied": "negated"}),
        Transducer("own", {("own", "R"): ("quoted", 1.0), ("quoted", "I"): ("quoted", 0.6), ("quoted", "H"): ("quoted", 0.6)}, {"quoted": "reported"}),
    ]


def grammar() -> Transducer:
    """The composed grammar."""
    out, *rest = machines()
    for m in rest:
        out = out.compose(m)
    return out


def clause_class(told: frozenset[str]) -> int:
    """Index into ``CLASSES``, or -1 for a clause that says nothing bad."""
    if not told & {"insult", "threat"}:
        return -1
    if "reported" in told:
        return 3
    if "negated" in told:
        return 2
    if "threat" in told:
        return 5 if "targeted" in told else 4
    return 1 if "targeted" in told else 0


class Grammar:
    """Finds clauses with learnt insults or threats and runs the grammar over them."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.lexicon = lexicon
        self.machine, self.transducer = ahocorasick.Automaton(), grammar()
        self.symbol = {w: s for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in words}
        self.runs: dict[tuple[str, ...], tuple[int, tuple[float, ...]]] = {}
        for p in [*lexicon, *(f"{w}." for w in THREATS)]:
            # A pattern that ends in "." is a whole word, any other one the start of words.
            key = f" {p[:-1]} " if p[-1] == "." else f" {p}"
            self.machine.add_word(key.encode().decode("latin-1"), 1)
        self.machine.make_automaton()

    def weight(self, word: str) -> float:
        """The lexicon's weight of a word: of the whole word, else of its longest known start; 0 if none."""
        if (w := self.lexicon.get(word + ".")) is not None:
            return w
        for n in range(min(len(word), STEMS[-1]), STEMS[0] - 1, -1):
            if (w := self.lexicon.get(word[:n])) is not None:
                return w
        return 0.0

    def clause(self, text: str) -> tuple[int, float]:
        """The class of a clause and its score: weights of its insults and threats times those of their arcs.

        A word can be a cue and an insult; it then stands for both, the cue first.
        """
        symbols, own = [], []
        for w in WORD.findall(text):
            if s := self.symbol.get(w):
                symbols.append(s)
                own.append(1.0 if s == "H" else 0.0)
            if x := self.weight(w):
                symbols.append("I")
                own.append(x)
        key = tuple(symbols)
        if (known := self.runs.get(key)) is None:
            told, weights = self.transducer.run(key)
            if len(self.runs) > 100_000:
                self.runs.clear()
            known = self.runs[key] = clause_class(told), weights
        kind, weights = known
        return kind, sum(x * w for x, w in zip(own, weights, strict=True)) if kind >= 0 else 0.0

    def features(self, text: str | None) -> np.ndarray:
        """Counts and summed weights of the clauses of each class, and how much text they stand in."""
        out = np.zeros(FEATURES)
        if not text:
            return out
        low = text.lower()
        line = f" {low.encode('utf-8', 'surrogatepass').translate(FOLD).decode('latin-1')} "
        n_words = max(1, len(line.split()))
        out[1] = math.log1p(n_words) / 10
        # The words that the grammar reads, so that none of its patterns is passed over.
        probe = f" {' '.join(WORD.findall(low))} ".encode("utf-8", "surrogatepass").decode("latin-1")
        if next(self.machine.iter(probe), None) is None:
            return out
        counts, sums = np.zeros(len(CLASSES)), np.zeros(len(CLASSES))
        for clause in CLAUSE_END.split(low):
            kind, total = self.clause(clause)
            if kind >= 0:
                counts[kind] += 1
                sums[kind] += total
        out[0] = 1.0
        out[2] = sums.sum() / math.sqrt(n_words)
        out[3] = math.log1p(counts.sum())
        out[4 : 4 + len(CLASSES)] = np.log1p(np.maximum(0, sums))
        out[4 + len(CLASSES) :] = 10 * sums / n_words
        return out


def in_training(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled rows outside of the held-out fifth, of the lowest hashes."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(in_training())
    # Of several labels of one document the highest counts.
    chosen = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and starts of words that stand in toxic rows far more often, with their log odds.

    Rows are counted in tasks first. All patterns with enough evidence are kept; a sample bounds their number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        toxic_total: Counter = Counter()
        docs = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = set()
                words = WORD.findall((text or "").lower())
                docs[toxic > 0] += 1
                for w in set(words):
                    found.add(w + ".")
                    found.update(w[:n] for n in STEMS if len(w) > n)
                (toxic_total if toxic else total).update(found)
        # What no toxic row of the task holds may still be held by those of others, so all rows are told.
        keys = list(total.keys() | toxic_total.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *keys], pa.string()), pa.array([docs[0], *(total[k] for k in keys)], pa.int64()), pa.array([docs[1], *(toxic_total[k] for k in keys)], pa.int64())], names=["key", "clean", "toxic"]
        )

    sums = rows.mapInArrow(count, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    base = sums.filter("key = ''").first()
    if base is None or not base["toxic"] or not base["clean"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (base["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (base["clean"] + 1))
    # Support first: a pattern needs enough toxic rows and a lift that chance doesn't give.
    good = sums.filter(f"key <> '' AND toxic >= {SUPPORT}").withColumn("odds", odds).filter((F.col("odds") > ODDS) & (F.col("odds") * F.sqrt("toxic") > EVIDENCE))
    found = {r["key"]: (r["odds"], r["toxic"]) for r in good.collect()}
    # From whole words to ever shorter starts: one is kept if it stands in clearly more toxic rows than any
    # kept pattern that it covers, so that no common start stands for one rare word.
    kept: dict[str, float] = {}
    support: dict[str, int] = {}  # of each start, the most rows that a kept pattern of it stands in
    for key in sorted(found, key=lambda k: (-len(k.rstrip(".")) - k.endswith("."), k)):
        if found[key][1] > 1.3 * support.get(key, 0):
            kept[key] = found[key][0]
            word = key.rstrip(".")
            for n in STEMS:
                if n < len(key):
                    support[word[:n]] = max(support.get(word[:n], 0), found[key][1])
    return kept


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights, from at most ``sample`` labelled rows; without labels of both kinds, even odds."""
    from oriel.llm.common import written

    rows = written(training_rows(docs, labels, sample), "sample")
    lexicon = learn_lexicon(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon)
        for batch in batches:
            x = [g.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = rows.mapInArrow(measure, "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()  # ``sample`` rows of few numbers
    if len({r["toxic"] for r in got}) < 2:
        return lexicon, np.zeros(FEATURES + 1)
    return lexicon, fit(np.array([r["x"] for r in got]), np.array([float(r["toxic"] > 0) for r in got]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    Labels are learnt from rows whose crc32 of the doc_id, as text, isn't divisible by 5. Scores depend on
    the text alone: null and empty texts get the score of a text without any matched clause. Repeated
    rows give a row each; of several labels of one doc_id the highest counts; a null doc_id isn't held out; a very
    long text is read clause by clause; other columns are left alone; an empty table gives no rows; without
    labels all scores are 0.5.
    """
    lexicon, weights = train(docs, labels, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon)
        for batch in batches:
            x = np.array([g.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~in_training(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
