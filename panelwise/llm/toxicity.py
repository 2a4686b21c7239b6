"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other.
Transducers rewrite a clause's symbols one after another and add weights; their
composition runs once over each clause:

    negation        an insult or threat shortly after a negation is denied
    reported speech after a verb of saying they are quoted
    target          a target near an insult or threat makes the clause direct

What stands before its target is found by a transducer that reads the rewritten
clause from its end.

A document's features are the weights of its matched clauses by outcome. How
much an outcome counts is learned: a logistic model, fitted on labelled
documents, scales the features of each into a score; an outcome that the labels
say nothing about counts as it does beforehand. The insults are learned from the labels too:
words, and stems of words, that occur in many toxic contexts and hardly
elsewhere, in each of two halves of the documents, so that chance words of one
half do not pass.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import share, slices, stored

# Words of each class in English, German, French and Spanish.
THREATS = """kill hurt destroy murder beat punch stab stabb shoot shot strangl töt umbring verletz schlag schläg
    vernicht tuer frapp détrui blesser massacr matar mató matando golpe destru destroz herir apuñal"""
ENDINGS = """s es ed d ing e en er ers et t te ten st é ée és ez ons ent re sez ai as a o ó an ar ir aré iré ando ado
    amos"""
TARGETS = """you your yours they them he she his her du dich dir ihr euch sie er tu te toi vous votre ils elle
    usted tú ti vosotros ellos ella él"""
NEGATIONS = """not no never none neither nor without cannot nicht kein keine nie niemals ohne ne pas jamais sans
    aucun nunca jamás sin ningún tampoco"""
REPORTS = """said says say called calls wrote writes claimed reported quoted according sagte sagt nannte schrieb
    laut dit disait appelé écrit selon dijo dice llamó escribió según"""

WORD = r"[^\W_]+"
CLAUSE = r"[.!?;:\n]+"
REACH = 3  # words over which negation and target reach
OUTCOMES = ["plain", "denied", "quoted", "direct", "threat", "clauses"]
#: How much the outcomes count, and the constant, where no label says otherwise.
BEFOREHAND = np.array([1.0, -0.5, 0.2, 1.5, 0.7, 0.0, -2.0])


def classes() -> dict[str, str]:
    """Word to symbol; a word of several classes has the first. Threats are stems with any of the endings."""
    out: dict[str, str] = {}
    threats = [stem + ending for stem in THREATS.split() for ending in ("", *ENDINGS.split())]
    for symbol, words in (("T", threats), ("N", NEGATIONS.split()), ("R", REPORTS.split()), ("G", TARGETS.split())):
        for w in words:
            out.setdefault(w, symbol)
    return out


class Transducer:
    """States are numbers from 0; a step gives output symbol, weight and next state."""

    def __init__(self, steps: dict[tuple[int, str], tuple[str, float, int]]):
        self.steps = steps

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.steps.get((state, symbol)) or self.steps.get((state, "*")) or (symbol, 0.0, state)


def compose(*machines: Transducer):
    """One machine that feeds each machine's output to the next; weights add up.

    Steps are worked out when first met, so only reachable states exist.
    """
    table: dict[tuple[tuple[int, ...], str], tuple[str, float, tuple[int, ...]]] = {}

    def step(states: tuple[int, ...], symbol: str) -> tuple[str, float, tuple[int, ...]]:
        known = table.get((states, symbol))
        if known is None:
            out, weight, after = symbol, 0.0, []
            for machine, state in zip(machines, states, strict=True):
                out, more, nxt = machine.step(state, out)
                weight += more
                after.append(nxt)
            known = table[states, symbol] = (out, weight, tuple(after))
        return known

    return step, (0,) * len(machines)


def countdown(trigger: str, changes: dict[str, tuple[str, float]], reach: int) -> Transducer:
    """For `reach` symbols after `trigger`, rewrites symbols with a weight."""
    steps: dict[tuple[int, str], tuple[str, float, int]] = {(0, trigger): (trigger, 0.0, reach)}
    for left in range(1, reach + 1):
        steps[left, trigger] = (trigger, 0.0, reach)
        for symbol in ["I", "T", "i", "t", "G", "N", "R", "O", "Q", "D"]:
            if symbol != trigger:
                out, weight = changes.get(symbol, (symbol, 0.0))
                steps[left, symbol] = (out, weight, left - 1)
    return Transducer(steps)


def grammar():
    """The composition: denial, then quotation, then direction at a target."""
    negation = countdown("N", {"I": ("i", -0.5), "T": ("t", -0.5)}, REACH)
    reported = Transducer({
        (0, "R"): ("R", 0.0, 1),
        (1, "I"): ("Q", -0.3, 1), (1, "i"): ("Q", -0.3, 1), (1, "T"): ("Q", -0.3, 1), (1, "t"): ("Q", -0.3, 1),
    })
    target = countdown("G", {"I": ("D", 0.5), "T": ("D", 0.5)}, REACH)
    return compose(negation, reported, target)


def grammar_from_end():
    """For the output of `grammar`, last symbol first: direction at a target that follows."""
    return compose(countdown("G", {"I": ("D", 0.5), "T": ("D", 0.5)}, REACH))


@dataclass
class ToxicModel:
    """Learned words and stems with their weights, and the logistic model."""

    words: dict[str, float]
    stems: dict[str, float]
    coefficients: np.ndarray  # of the features, then the constant

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if len(word) > n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.coefficients[:-1] + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


STEM_LENGTHS = (4, 5, 6)


class Scanner:
    """Finds matched clauses of texts; texts without a learned word or threat are passed over fast."""

    def __init__(self, model: ToxicModel):
        import ahocorasick

        self.model = model
        self.symbols = classes()
        self.step, self.start = grammar()
        self.step_back, self.end = grammar_from_end()
        self.words, self.clauses = re.compile(WORD).findall, re.compile(CLAUSE).split
        self.any = ahocorasick.Automaton()
        for w in [*model.words, *model.stems, *THREATS.split()]:  # every threat begins with its stem
            self.any.add_word(w, 1)
        self.any.make_automaton()

    def features(self, text: str) -> list[float]:
        """Weights by outcome: plain, denied, quoted, direct, threat; and the number of matched clauses."""
        out = dict.fromkeys(OUTCOMES, 0.0)
        lower = text.lower()
        if next(self.any.iter(lower), None) is not None:
            for clause in self.clauses(lower):
                if next(self.any.iter(clause), None) is not None:
                    self._clause(self.words(clause), out)
        # What a text gains by another match shrinks, so that length alone does not decide.
        return [float(np.log1p(max(0.0, out[o]))) for o in OUTCOMES]

    def _clause(self, words: list[str], out: dict[str, float]) -> None:
        states, read = self.start, []
        for w in words:
            symbol, own = self.symbols.get(w, "O"), 1.0
            if symbol == "O":
                learned = self.model.weight(w)
                if learned > 0:
                    symbol, own = "I", learned
            result, weight, states = self.step(states, symbol)
            read.append((result, own, weight))
        states, found = self.end, False
        for symbol, own, weight in reversed(read):
            result, more, states = self.step_back(states, symbol)
            if result in "ItTiDQ":
                kind = {"I": "plain", "i": "denied", "t": "denied", "Q": "quoted", "D": "direct", "T": "threat"}[result]
                out[kind] += own * (1 + weight + more)
                found = True
        out["clauses"] += found


COUNTS = ["toxic_0", "other_0", "toxic_1", "other_1"]


def evidence(sample: DataFrame) -> DataFrame:
    """Per word and stem: documents and kinds of preceding words, in toxic and other texts of either half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(WORD).findall, defaultdict(lambda: [0, 0, 0, 0, 0])
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: dict[str, int] = defaultdict(int)
                last = ""
                for w in find((text or "").lower()):
                    bit = 1 << (sum(map(ord, last)) % 62)
                    own[w] |= bit
                    for n in STEM_LENGTHS:
                        if len(w) > n:
                            own[w[:n] + "*"] |= bit
                    last = w
                for w, bits in own.items():
                    cell = seen[w]
                    cell[2 * half + (not toxic)] += 1
                    if toxic:
                        cell[4] |= bits
        columns = list(zip(*seen.values(), strict=True)) if seen else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns)],
            ["word", *COUNTS, "before"],
        )

    half = F.pmod("draw", F.lit(2)).cast("int").alias("half")
    fields = ", ".join(f"{c} long" for c in ("word", *COUNTS, "before")).replace("word long", "word string")
    counted = sample.select("text", "toxic", half).mapInArrow(count, fields)
    return counted.groupBy("word").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.bit_count(F.bit_or("before")).alias("before")
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, beforehand: np.ndarray | None = None) -> np.ndarray:
    """Coefficients and constant by Newton steps, drawn towards what they are beforehand (0)."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.zeros(x.shape[1]) if beforehand is None else beforehand
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def train(
    labelled: DataFrame,
    labels: DataFrame | None = None,
    *,
    fit_rows: int = 20_000,
    least_documents: int = 5,
    least_contexts: int = 4,
    share: float = 0.7,
) -> ToxicModel:
    """A model from (doc_id, text, toxic), or from (doc_id, text) and `labels` (doc_id, toxic).

    Rows are drawn by ids and hashes, and only the texts drawn are fetched, so
    the texts of documents that are joined with labels are never shuffled.
    Fitted on a bounded sample: the `fit_rows` rows with the lowest hashes of
    id and text, one of equal texts. A word or stem is learned if at least
    `least_documents` toxic texts hold it, after at least `least_contexts`
    kinds of words (else it is what copies of one text share), and in either
    half of the sample at least `share` of the texts that hold it are toxic.
    Rows with a null text or label are left out. No rows: a model that knows no
    word and weighs outcomes as beforehand. The learned words come from the
    sample, so its bound is theirs.
    """
    h, draw = F.xxhash64("text").alias("h"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("draw")
    toxic = F.col("toxic").cast("int").alias("toxic")
    whole = labelled.where("text is not null")
    if labels is None:
        keys = whole.where("toxic is not null").select(h, draw, toxic)
    else:
        marks = labels.where("toxic is not null").select("doc_id", toxic)
        keys = whole.select("doc_id", h, draw).join(marks, "doc_id").select("h", "draw", "toxic")
    # At most fit_rows rows of three numbers are broadcast.
    drawn = keys.groupBy("h").agg(F.min(F.struct("draw", "toxic")).alias("least")).select("h", "least.draw", "least.toxic")
    drawn = drawn.orderBy("draw", "h").limit(fit_rows)
    fetched = whole.select("text", h, draw).join(F.broadcast(drawn), ["h", "draw"]).dropDuplicates(["h"])
    sample = stored(fetched, "toxic-sample").repartition(16)
    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, other = F.col("toxic_0") + F.col("toxic_1"), F.col("other_0") + F.col("other_1")
    weight = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n - n_toxic + 1))
    best = evidence(sample).where((toxic >= least_documents) & (F.col("before") >= least_contexts))
    for half in (0, 1):
        own, rest = F.col(f"toxic_{half}"), F.col(f"other_{half}")
        best = best.where((own > 0) & (own >= share * (own + rest)))
    found = best.withColumn("weight", weight).where("weight > 0").select("word", "weight").collect()
    words = {r["word"]: float(r["weight"]) for r in found if not r["word"].endswith("*")}
    stems = {r["word"][:-1]: float(r["weight"]) for r in found if r["word"].endswith("*")}
    model = ToxicModel(words, stems, BEFOREHAND.copy())
    measured = with_features(sample, model, ["toxic"]).select("toxic", "features").collect()  # fit_rows rows
    if measured:
        x = np.array([r["features"] for r in measured])
        model.coefficients = fit_logistic(x, np.array([r["toxic"] for r in measured], float), beforehand=BEFOREHAND)
    return model


def with_features(docs: DataFrame, model: ToxicModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with the features and score of each whole text; null is empty."""
    model_of = share(docs.sparkSession, model)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model_of())
        for batch in batches:
            for own in slices(batch, n, 8_000_000):
                rows = [scanner.features(t or "") for t in own.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:n], pa.array(rows, pa.list_(pa.float64())), pa.array(model_of().score(np.array(rows)))],
                    [*(f"c{i}" for i in range(n)), "features", "score"],
                )

    given = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = given.mapInArrow(run, ", ".join([*fields, "features array<double>, score double"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "features", "score")


def score(docs: DataFrame, model: ToxicModel, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (all by default), score and predicted (1 from 0.5 on).

    Whole texts are read, however long, clause by clause; null is empty. Equal
    rows score alike; no rows give no rows.

    Kept columns called score or predicted give way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"score", "predicted", "features"}]
    found = with_features(docs, model, keep, text_col)
    return found.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
