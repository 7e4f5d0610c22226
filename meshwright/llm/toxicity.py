"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses (up to . ! ? ; : or a line end) of words.  A lexicon
transducer writes each word as a symbol: insult, threat, intent, target, negation,
report, or other.  Grammar transducers then rewrite the symbols in turn: negation (an
insult soon after a negation is denied), reported speech (insults of a clause that
reports somebody's words are quoted), target (an insult beside a person spoken to or
of is aimed), and threat (an intent followed by a threat verb and a target).  They are
composed into one deterministic transducer whose last step gives each matched symbol a
weight; a clause scores the sum of its path, the text the sum of its clauses, and a
rising curve makes this a probability.

The insult lexicon has public seed words and is completed from labelled rows: word
beginnings and whole words that stand mostly in rows labelled toxic, in many different
surroundings (so that one copied text teaches nothing).  The labelled rows are a
bounded sample (``SAMPLE`` rows, those of the smallest doc_id hashes); the weights and
the curve are fitted on it.  Labels, lang, source and doc_id are no inputs of a score.

Null text is empty; it scores what a text without matches scores.  Null labels are not
learnt from; a table without labels leaves the seed words with their default weights.  Very long texts are
read whole, clause by clause; repeated rows have equal scores, and of several labels of one doc_id toxic counts; an empty table
of documents gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import stored, table, whole_text

#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE = 24_000
THRESHOLD = 0.3
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
SEEDS: dict[int, list[str]] = {
    INSULT: "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool coward pig liar".split(),
    THREAT: "kill hurt destroy beat punch shoot stab burn ruin".split(),
    INTENT: "will shall gonna going must should".split(),
    TARGET: "you your yours yourself he she they him her them".split(),
    NEGATION: "not no never nobody isn aren wasn don doesn didn without".split(),
    REPORT: "said says say wrote writes called calls quoted quote reported claimed claims".split(),
}
#: What the grammar writes for a weighed symbol.
PLAIN, AIMED, DENIED, QUOTED, MENACE = "plain", "aimed", "denied", "quoted", "menace"
#: Share of an insult's weight that counts, by what the grammar made of it.
SHARE = {PLAIN: 1.0, AIMED: 1.25, DENIED: 0.25, QUOTED: 0.5, MENACE: 1.0}
#: Words that a negation, a target or an intent reaches.
REACH = 3
DEFAULT_WEIGHT, MENACE_WEIGHT, MOST_WEIGHT = 3.0, 4.0, 6.0
#: Totals and probabilities before anything is learnt.
DEFAULT_CURVE = [(0.0, 0.05), (3.0, 0.6), (6.0, 0.95)]
PREFIXES = range(3, 9)
#: Uses of a word that count in one row, so that a word repeated over and over is no rule.
MOST_USES = 3
LEAST_ROWS, LEAST_SURROUNDINGS, LEAST_WEIGHT = 4, 6, 2.0
#: Likelihood gain (as a G statistic) that an entry must exceed.
ENTRY_COST = 60.0
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A deterministic finite-state transducer: (state, symbol) gives a state and an output symbol."""

    def __init__(self, start: object, step) -> None:
        self.start, self.step = start, step
        self.arcs: dict[tuple[object, object], tuple[object, object]] = {}

    def move(self, state: object, symbol: object) -> tuple[object, object]:
        if (state, symbol) not in self.arcs:
            self.arcs[state, symbol] = self.step(state, symbol)
        return self.arcs[state, symbol]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes the other reads."""

        def step(state: tuple, symbol: object) -> tuple:
            mine, out = self.move(state[0], symbol)
            theirs, last = other.move(state[1], out)
            return (mine, theirs), last

        return Transducer((self.start, other.start), step)


def _reach(opens: int, rewrite: dict[object, object]) -> Transducer:
    """After a symbol ``opens``, rewrite symbols within REACH words."""

    def step(left: int, symbol: object) -> tuple[int, object]:
        if symbol == opens:
            return REACH + 1, symbol
        return max(0, left - 1), rewrite.get(symbol, symbol) if left else symbol

    return Transducer(0, step)


def _threat() -> Transducer:
    """An intent, then a threat verb, then a target, each within reach, write a menace."""

    def step(state: tuple[int, int], symbol: object) -> tuple[tuple[int, int], object]:
        stage, left = state
        if symbol == INTENT:
            return (1, REACH), symbol
        if symbol == THREAT and stage == 1 and left:
            return (2, REACH), symbol
        if symbol == TARGET and stage == 2 and left:
            return (0, 0), MENACE
        return (stage, left - 1) if left > 1 else (0, 0), symbol

    return Transducer((0, 0), step)


def _report() -> Transducer:
    """After a reporting word insults of the clause are quoted."""

    def step(reported: int, symbol: object) -> tuple[int, object]:
        if symbol == REPORT:
            return 1, symbol
        return reported, QUOTED if reported and symbol in (INSULT, AIMED) else symbol

    return Transducer(0, step)


def grammar() -> Transducer:
    """Threat, target, negation and reported speech, composed in this order."""
    return _threat().then(_reach(TARGET, {INSULT: AIMED})).then(_reach(NEGATION, {INSULT: DENIED, AIMED: DENIED, MENACE: DENIED})).then(_report())


@dataclasses.dataclass
class Model:
    """The fitted lexicon (whole words and word beginnings, with weights) and the curve from totals to probabilities."""

    words: dict[str, float]
    beginnings: dict[str, float]
    curve: list[tuple[float, float]] = dataclasses.field(default_factory=lambda: list(DEFAULT_CURVE))

    def __post_init__(self) -> None:
        self.kinds = {w: kind for kind, ws in SEEDS.items() if kind != INSULT for w in ws}
        self._built: tuple[Transducer, ahocorasick.Automaton] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    def built(self) -> tuple[Transducer, ahocorasick.Automaton]:
        """The composed transducer and the automaton that finds words with a weight, made once in each worker."""
        if self._built is None:
            find = ahocorasick.Automaton()
            for word in {*self.words, *self.beginnings, *SEEDS[THREAT]}:
                find.add_word(word, len(word))
            find.make_automaton()
            self._built = grammar(), find
        return self._built

    def weight(self, word: str) -> float | None:
        if word in self.words:
            return self.words[word]
        found = [self.beginnings[word[:n]] for n in PREFIXES if word[:n] in self.beginnings]
        return max(found) if found else None

    def clause(self, text: str) -> float:
        """The weight of the composed transducer's path over one clause."""
        machine = self.built()[0]
        total, state = 0.0, machine.start
        for word in _WORD.findall(text):
            weight = self.weight(word)
            symbol = INSULT if weight is not None else self.kinds.get(word, OTHER)
            state, out = machine.move(state, symbol)
            if out == MENACE:
                total += MENACE_WEIGHT
            elif out in (INSULT, AIMED, DENIED, QUOTED) and weight is not None:
                total += weight * SHARE[PLAIN if out == INSULT else out]
        return total

    def total(self, text: str) -> float:
        """The sum over the clauses that hold a word with a weight; the others weigh nothing."""
        low, total, done = text.lower(), 0.0, 0
        for last, size in self.built()[1].iter(low):
            first = last - size + 1
            if first < done or first and low[first - 1].isalpha():
                continue
            begin = done
            for mark in _CLAUSE.finditer(low, max(done, max(low.rfind(c, done, first) for c in ".!?;:\n")), first):
                begin = mark.end()
            after = _CLAUSE.search(low, first)
            done = after.end() if after else len(low)
            total += self.clause(low[begin:done])
        return total

    def score(self, total: float) -> float:
        """The probability that the curve gives a total, with a slight rise where it is flat."""
        share = float(np.interp(total, [x for x, _ in self.curve], [p for _, p in self.curve]))
        return min(1.0, max(0.0, 0.999 * share + 0.001 * (total / (1.0 + total))))


def fit_curve(points: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """A rising curve (total, probability) through (total, label, rows): pooled neighbours where the share would fall."""
    sums: dict[float, list[float]] = {}
    for x, y, n in points:
        cell = sums.setdefault(x, [0.0, 0.0])
        cell[0] += n * y
        cell[1] += n
    blocks: list[list[float]] = []  # toxic rows, rows, sum of totals
    for x, (bad, n) in sorted(sums.items()):
        blocks.append([bad, n, n * x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [(total / n, (bad + 0.05) / (n + 0.1 + 0.3 * (bad < n))) for bad, n, total in blocks]


def keys_of(word: str) -> list[str]:
    """A word's beginnings, and the word itself marked by a trailing blank."""
    return [*(word[:n] for n in PREFIXES if len(word) >= n), *([word + " "] if len(word) >= PREFIXES[0] else [])]


def fold_of(text: str) -> int:
    return hash_of(text) % 2


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By fold and key: uses in rows of either label, toxic rows, and a bitmap of the surroundings in these. The empty key counts all words."""
    uses = {(fold, label): Counter() for fold in (0, 1) for label in (0, 1)}
    rows: tuple[Counter, Counter] = Counter(), Counter()
    around: tuple[dict, dict] = {}, {}
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words, fold = _WORD.findall(text.lower()), fold_of(text)
            counted = Counter(words)
            use, seen = uses[fold, label], set()
            use[""] += len(words)
            per_key: Counter = Counter()
            for word, n in counted.items():
                for key in keys_of(word):
                    per_key[key] += min(n, MOST_USES)
            use.update(per_key)
            if label:
                seen.update(per_key)
            if label:
                rows[fold].update(seen)
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    bit = 1 << (hash_of(before + " " + after) % 63)
                    for key in keys_of(word):
                        around[fold][key] = around[fold].get(key, 0) | bit
    for fold in (0, 1):
        keys = list({**uses[fold, 0], **uses[fold, 1]})
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pd.DataFrame({"key": part, "fold": fold, "bad": [uses[fold, 1][k] for k in part], "good": [uses[fold, 0][k] for k in part], "rows": [rows[fold][k] for k in part], "around": [around[fold].get(k, 0) for k in part]})


def hash_of(text: str) -> int:
    """A hash that is the same in every worker."""
    return zlib.crc32(text.encode())


def learn(labelled: DataFrame) -> Model:
    """Fit the lexicon, its weights and the curve on rows of (text, label 0 or 1); equal texts count once.

    The curve is fitted on totals that each half of the rows gets from the lexicon of the other half.
    """
    rows = stored(labelled.dropDuplicates(["text", "label"]))
    parts = rows.select("text", "label").mapInPandas(_evidence, "key string, fold int, bad long, good long, rows long, around long")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("bad", "good", "rows")]
    sums = parts.groupBy("key").agg(*by_fold, F.bit_count(F.bit_or("around")).alias("around"))
    worth = (F.col("rows0") + F.col("rows1") >= LEAST_ROWS) & (F.col("around") >= LEAST_SURROUNDINGS) & (F.col("bad0") + F.col("bad1") > 0.05 * (F.col("good0") + F.col("good1")))
    found = [r.asDict() for r in sums.where((F.col("key") == "") | worth).collect()]  # at most the words of the sample's toxic rows
    halves = [Model(*lexicon(found, (0,))), Model(*lexicon(found, (1,)))]

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"total": [round(min(halves[1 - fold_of(x)].total(x), 60.0) * 4) / 4 for x in batch["text"]], "label": batch["label"]})

    points = rows.select("text", "label").mapInPandas(totals, "total double, label int").groupBy("total", "label").count().collect()
    model = Model(*lexicon(found, (0, 1)))
    if {p["label"] for p in points} == {0, 1}:
        model.curve = fit_curve([(p["total"], p["label"], p["count"]) for p in points])
    return model


def lexicon(found: list[dict], folds: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of whole words and of beginnings.

    The beginnings form a tree.  An entry is worth the likelihood gained by giving it a
    rate of its own in toxic rows, less a fixed cost; a beginning stands for all words
    below it where that is worth more than the best entries below it together.
    """
    words, beginnings = dict.fromkeys(SEEDS[INSULT], DEFAULT_WEIGHT), {}
    sums = {r["key"]: (sum(r[f"bad{f}"] for f in folds), sum(r[f"good{f}"] for f in folds), sum(r[f"rows{f}"] for f in folds)) for r in found}
    all_bad, all_good, _ = sums.pop("", (0, 0, 0))
    if not all_bad or not all_good:
        return words, beginnings
    below: dict[str, tuple[float, list[str]]] = {}
    weights: dict[str, float] = {}
    for key in sorted(sums, key=lambda k: (-len(k.strip()), not k.endswith(" "), k)):
        bad, good, rows = sums[key]
        gain, entries = below.pop(key, (0.0, []))
        share = all_bad / (all_bad + all_good)
        weights[key] = min(MOST_WEIGHT, math.log((bad + 0.5) / (good + 0.5) * all_good / all_bad))
        if rows >= LEAST_ROWS and weights[key] >= LEAST_WEIGHT:
            own = 2 * (bad * math.log(bad / ((bad + good) * share)) + (good * math.log(good / ((bad + good) * (1 - share))) if good else 0.0)) - ENTRY_COST
            if own > gain:
                gain, entries = own, [key]
        exact = key.strip()
        shorter = [exact[:n] for n in reversed(PREFIXES) if n < len(exact) or key.endswith(" ") and n == len(exact)]
        parent = next((k for k in shorter if k in sums), None)
        mine, others = below.get(parent or "", (0.0, []))
        below[parent or ""] = mine + gain, others + entries
    for key in below.get("", (0.0, []))[1]:
        (words if key.endswith(" ") else beginnings)[key.strip()] = weights[key]
    return words, beginnings


def totals_of(text: Column, model: Model) -> Column:
    """Score (0 to 1) of each text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: model.score(model.total(x)))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that may be learnt from, those of the smallest doc_id hashes.

    Learnt from are rows whose crc32(doc_id) modulo 4 is not 2.  The chosen ids are few
    enough by their bound to be broadcast, so that no text is shuffled to find them.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with score and predicted."""
    return docs.withColumn("score", totals_of(F.col("text"), model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
