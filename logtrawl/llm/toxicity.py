"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause: insults and threats emit weights; a target, a negation and reported speech change the
weight of what is emitted while they hold. They are composed into one machine, built state by state as clauses need
it. A text is scored by its matched clauses: their sum, their density, the heaviest, and how many there are. A logistic
function of these, fitted on labelled rows, gives the score.

Insults are learned: beginnings of words, and whole words, that are much more frequent in toxic rows. The labelled rows
that serve for that are a sample of about ``TRAIN_ROWS`` by a hash of their id; counts of their words are summed up
before each shuffle, and at most ``ENTRIES`` entries and ``TRAIN_ROWS`` rows of five numbers come to the driver.
All rows are scored in one map over whole texts. Null and empty texts get the score of a text without matches; without
labels only the fixed words count; repeated ids are scored row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, staged, whole_text

TRAIN_ROWS = 20_000
ENTRIES = 400
SHORTEST, LONGEST = 4, 8
CLAUSE = 300
HELD = 150_000  # counts held before they are passed on
THRESHOLD = 0.3
THREATS = "kill hurt destroy beat stab shoot murder strangle burn".split()
INTENTS = "will gonna going shall ll want".split()
TARGETS = "you your yours u ur he she him her they them their tu vous du ihr sie usted".split()
NEGATIONS = "not no never neither nor without isn aren wasn don doesn didn cannot kein nicht pas jamais nunca".split()
REPORTS = "said says say quoted quote quotes wrote reported claimed alleged told called".split()
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
_END = re.compile(r"[.!?;\n|]")


# Transducers over word classes: state, class -> next state. What they do to a clause is in ``_step``.
def _report(state: int, kind: str) -> int:
    """0 outside, 1 inside quotes, 2 behind a word of speech, which holds to the end."""
    if kind == "report":
        return 2
    return 1 - state if kind == "quote" and state < 2 else state


def _negation(state: int, kind: str) -> int:
    """How many more words it holds."""
    return 3 if kind == "negation" else max(0, state - 1)


def _target(state: int, kind: str) -> int:
    return 1 if kind == "target" else state


def _threat(state: int, kind: str) -> int:
    """How many more words an intent holds."""
    return 3 if kind == "intent" else max(0, state - 1)


@cache
def _step(state: tuple[int, int, int, int], kind: str) -> tuple[tuple[int, int, int, int], float]:
    """The composed machine: the next state, and what an emission of weight one counts."""
    report, negation, target, threat = state
    factor = 0.0
    if kind in ("insult", "threat"):
        factor = (0.4 if report else 1.0) * (0.3 if negation else 1.0) * (1.5 if target else 1.0)
        if kind == "threat":
            factor *= 4.0 if threat and target else 1.5 if threat or target else 0.2
    return (_report(report, kind), _negation(negation, kind), _target(target, kind), _threat(threat, kind)), factor


_KIND = {w: k for k, words in (("threat", THREATS), ("intent", INTENTS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
_KIND |= dict.fromkeys('"“”«»', "quote")


class Grammar:
    """Scores texts. ``insults`` has weights by word beginning, or by whole word with a ``$`` behind it."""

    def __init__(self, insults: dict[str, float]):
        import ahocorasick

        self.insults = insults
        self.finder = ahocorasick.Automaton()
        for entry in insults:
            self.finder.add_word(entry.rstrip("$"), entry.rstrip("$"))
        for word in THREATS:
            self.finder.add_word(word, word)
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        found = self.insults.get(word + "$", 0.0)
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if word[:n] in self.insults:
                return max(found, self.insults[word[:n]])
        return found

    def clause(self, text: str) -> tuple[float, int]:
        """Weight of a clause, and the number of emissions."""
        state, total, count = (0, 0, 0, 0), 0.0, 0
        for word in _WORD.findall(text):
            weight = self.weight(word)
            kind = "insult" if weight else _KIND.get(word, "other")
            state, factor = _step(state, kind)
            if factor:
                total += factor * (weight or 1.0)
                count += 1
        return total, count

    def features(self, text: str) -> tuple[float, float, float, float, float]:
        """Of a whole text: log sums of its matched clauses, their share of the words, heaviest, number, emissions."""
        text = text.lower()
        total, heaviest, clauses, count, done = 0.0, 0.0, 0, 0, 0
        for end, word in self.finder.iter(text):
            begin = end - len(word) + 1
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            # a clause has at most CLAUSE characters before and behind the match that opens it
            floor = max(done, begin - CLAUSE)
            left = max((text.rfind(c, floor, begin) for c in ".!?;\n|"), default=-1)
            if left < 0:
                left = text.find(" ", floor, begin) if floor > done else floor - 1
                if floor > done and left < 0:  # no blank either: what is left of a cut word is none
                    left = floor - 1
                    while left + 1 < begin and text[left].isalpha() and text[left + 1].isalpha():
                        left += 1
            right = _END.search(text, end + 1, end + 1 + CLAUSE)
            if right:
                done = right.start()
            else:
                done = min(len(text), end + 1 + CLAUSE)
                while done < len(text) and text[done].isalpha() and done < end + 2 * CLAUSE:
                    done += 1
            w, n = self.clause(text[left + 1 : done])
            if w > 0:
                total, heaviest, clauses, count = total + w, max(heaviest, w), clauses + 1, count + n
        words = text.count(" ") + 1
        return math.log1p(total), math.log1p(100 * total / words), math.log1p(heaviest), math.log1p(clauses), math.log1p(1000 * count / words)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """``text, toxic`` of a sample of the labelled rows that pass ``keep``."""
    known = labels.filter("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).filter(keep)
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(known, "id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Beginnings of words and whole words with their log odds in toxic rows, from all given rows (``text, toxic``).

    An entry stands in at least four toxic rows; a longer beginning only counts if it says more than a shorter one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic_uses, rows_with = Counter(), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            entries = list(clean.keys() | toxic_uses.keys())
            columns = [pa.array(entries, pa.string())] + [pa.array([c[e] for e in entries], pa.int64()) for c in (clean, toxic_uses, rows_with)]
            for c in (clean, toxic_uses, rows_with):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "clean", "toxic", "rows"])

        for batch in by_bytes(batches, 0):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(w for w in _WORD.findall(text.lower()) if len(w) >= SHORTEST)
                own: Counter = Counter()
                for w, n in words.items():
                    own[w + "$"] += n
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        own[w[:k]] += n
                own[""] = sum(words.values())
                (toxic_uses if toxic > 0 else clean).update(own)
                if toxic > 0:
                    rows_with.update(own.keys())
                if len(clean) + len(toxic_uses) > HELD:
                    yield counted()
        yield counted()

    counts = rows.mapInArrow(count, "entry string, clean long, toxic long, rows long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "rows")])
    counts = staged(counts.filter("entry = '' or rows >= 4"), "toxic-words")
    whole = counts.filter("entry = ''").first()
    if not whole or not whole["toxic"]:
        return {}
    odds = f"ln((toxic + 0.5) / {whole['toxic'] + 1.0}) - ln((clean + 0.5) / {whole['clean'] + 1.0})"
    best = counts.filter("entry != ''").withColumn("odds", F.expr(odds)).filter("odds >= 2.5").orderBy(F.expr("odds * sqrt(rows)").desc(), "entry").limit(ENTRIES).collect()
    found = {r["entry"]: min(float(r["odds"]), 7.0) for r in best}
    return {e: w for e, w in found.items() if not any(found.get(e[:n], 0) >= w - 0.5 for n in range(SHORTEST, len(e.rstrip("$")) + (e[-1] == "$")))}


def fit(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights, the bias last, by Newton steps; without rows of both kinds, a plain prior."""
    if len(set(toxic.tolist())) < 2:
        return np.array([1.0, 0.0, 0.5, 0.0, 0.0, -3.0])
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    penalty = np.diag([ridge] * features.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - toxic) + penalty @ w)
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "true") -> DataFrame:
    """``docs`` with the columns ``_toxic_score`` and ``_toxic_predicted``; ``keep`` says in SQL which label rows (by ``id``) may be learned from."""
    rows = staged(_labelled(docs, labels, id_col, text_col, keep), "toxic-rows")
    insults = learn_insults(rows)
    names = ["f0", "f1", "f2", "f3", "f4"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in by_bytes(batches, 0):
            found = np.array([grammar.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found.T)], ["toxic", *names])

    seen = rows.mapInArrow(measure, "toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()  # about TRAIN_ROWS rows
    weights = fit(seen[names].to_numpy(), (seen["toxic"].to_numpy() > 0).astype(float))
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in by_bytes(batches, at):
            found = np.array([grammar.features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema.names)

    schema = T.StructType([*docs.schema.fields, T.StructField("_toxic_score", T.DoubleType()), T.StructField("_toxic_predicted", T.IntegerType())])
    return docs.mapInArrow(judge, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "true") -> DataFrame:
    """The rows of ``docs`` whose score stays below ``THRESHOLD``."""
    return score(docs, labels, id_col, text_col, keep).filter("_toxic_predicted = 0").select(*docs.columns)
