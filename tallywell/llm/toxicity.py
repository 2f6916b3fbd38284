"""Toxicity as matched clauses of a weighted finite-state grammar.

Words become symbols: insult, threat, target (second person), negation, reported speech, other. Transducers read the
symbols of a clause and rewrite them: one marks insults and threats behind a negation, one those behind a verb of
speaking, one joins threats and insults with a target. They are composed into one machine, so a clause is read once, and
what comes out is counted by kind: a negated or reported insult is not the same as one thrown at somebody. A match counts by
the square of its weight, so that some doubtful ones do not weigh as much as a sure one.

Insults are stems, matched as prefixes of words. Some are given; more are learned from labelled documents: of all
prefixes, those that toxic documents have far more often than others have (a log-likelihood ratio above EVIDENCE plus the
logarithm of the number of prefixes tried, and LEAST_TOXIC documents at least). A document speaks for a prefix by the
logarithm of how often it has it: repeats count, but no single document decides. A stem's weight is its log odds. The
weights of the kinds of clauses come from a logistic regression on the same documents that starts from given weights and
stays near them where data are few.

Fitting reads at most FIT_ROWS labelled documents, the first by a hash of their id. Scoring reads every document whole.
Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has no clause and gets the score of the intercept; documents that repeat are
scored each; without labelled documents the given weights hold; if a document has several labels the highest counts.
Other columns are not read, or passed on as they are where rows are filtered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import per_batch
from tallywell.llm.words import NOT_ALPHANUMERIC, as_bytes, chunks, owner_of, word_hashes
from tallywell.session import materialise

FIT_ROWS = 20_000
EVIDENCE = 2.0
LEAST_TOXIC = 3
#: Evidence is added up in whole parts, so that sums do not depend on the order of rows.
PARTS = 1000
PREFIXES = tuple(range(3, 13))
CLAUSE_ENDS = bytes(int(chr(i) in ".!?;:\n") for i in range(256))

# Given words, in English, French, German and Spanish.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecil", "dumbass",
           "crétin", "connard", "salope", "débile", "arschloch", "dummkopf", "trottel", "schlampe", "estúpid", "pendejo", "gilipollas"]
THREATS = ["kill", "hurt", "destroy", "murder", "beat", "stab", "tuer", "tuerai", "frapper", "töten", "umbringen", "schlagen", "matar",
           "mataré", "golpear"]
TARGETS = ["you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "ihr", "euch", "tú",
           "ti", "usted", "ustedes", "vosotros"]
NEGATIONS = ["not", "no", "never", "isn", "aren", "don", "ne", "jamais", "nicht", "kein", "keine", "nie", "nunca", "jamás"]
REPORTS = ["said", "says", "say", "called", "calls", "wrote", "claimed", "quoted", "dit", "disait", "écrit", "sagte", "sagt", "schrieb",
           "nannte", "dijo", "dice", "escribió", "llamó"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED, DIRECTED, THREATENED = range(10)
KINDS = (INSULT, DIRECTED, NEGATED, REPORTED, THREATENED)
#: Given weights: intercept, one per kind (of the logarithm of its weight), share of the text that matched.
PRIOR = np.array([-4.0, 2.0, 2.5, 0.3, 0.7, 3.0, 2.0])


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (state, symbol written). Where there is no arc, state and symbol stay."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    states: int = field(default=1)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes."""
        arcs = {}
        for a in range(self.states):
            for b in range(other.states):
                for symbol in range(10):
                    a2, written = self.step(a, symbol)
                    b2, result = other.step(b, written)
                    arcs[a * other.states + b, symbol] = (a2 * other.states + b2, result)
        return Transducer(arcs, self.states * other.states)

    def read(self, symbols: list[int]) -> list[int]:
        state, written = 0, []
        for symbol in symbols:
            state, out = self.step(state, symbol)
            written.append(out)
        return written


NEGATING = Transducer({(0, NEGATION): (1, NEGATION), (1, INSULT): (1, NEGATED), (1, THREAT): (1, OTHER)}, 2)
REPORTING = Transducer({(0, REPORT): (1, REPORT), (1, INSULT): (1, REPORTED), (1, THREAT): (1, OTHER)}, 2)
#: States: nothing, target seen, threat seen without its target.
TARGETING = Transducer({(0, TARGET): (1, TARGET), (0, THREAT): (2, OTHER), (1, THREAT): (1, THREATENED), (1, INSULT): (1, DIRECTED),
                        (2, TARGET): (1, THREATENED)}, 3)
GRAMMAR = NEGATING.then(REPORTING).then(TARGETING)


@dataclass(frozen=True)
class Model:
    stems: np.ndarray  # sorted hashes of prefixes
    weights: np.ndarray
    kinds: np.ndarray  # weights of the features

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.kinds, -30, 30)))


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes([" ".join(words).encode()], NOT_ALPHANUMERIC)[0]


_SYMBOLS = {INSULT: INSULTS, THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
_KNOWN = np.concatenate([_hashes(words) for symbol, words in _SYMBOLS.items() if symbol != INSULT])
_ORDER = np.argsort(_KNOWN)
_KNOWN = _KNOWN[_ORDER]
_SYMBOL_OF = np.concatenate([np.full(len(words), symbol) for symbol, words in _SYMBOLS.items() if symbol != INSULT])[_ORDER]


def _lower(texts: list[bytes]) -> list[bytes]:
    return [text.lower() if text.isascii() else text.decode().lower().encode() for text in texts]


def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def features(texts: list[bytes], stems: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row per text: 1, the logarithm of the weight of each kind of clause, the matched share of the words."""
    texts = _lower(texts)
    words, bounds, starts, _, *heads = word_hashes(texts, NOT_ALPHANUMERIC, True, PREFIXES)
    weight = np.zeros(len(words))
    for values in heads:
        at, hit = _find(stems, values)
        np.maximum(weight, np.where(hit, weights[at], 0.0), out=weight)
    at, hit = _find(_KNOWN, words)
    symbols = np.where(weight > 0, INSULT, np.where(hit, _SYMBOL_OF[at], OTHER))

    totals = np.zeros((len(texts), len(KINDS)))
    hot = np.unique(owner_of(bounds)[(symbols == INSULT) | (symbols == THREAT)])
    for i in hot.tolist():  # texts with something to match
        low, high = int(bounds[i]), int(bounds[i + 1])
        telling = low + np.flatnonzero(symbols[low:high])
        ends = np.flatnonzero(np.frombuffer(texts[i].translate(CLAUSE_ENDS), np.uint8))
        clauses = np.searchsorted(ends, starts[telling])
        cuts = [0, *(np.flatnonzero(np.diff(clauses)) + 1).tolist(), len(telling)]
        for begin, end in zip(cuts, cuts[1:]):
            own = telling[begin:end]
            for place, symbol in zip(own.tolist(), GRAMMAR.read(symbols[own].tolist())):
                if symbol in KINDS:
                    totals[i, KINDS.index(symbol)] += weight[place] ** 2 / 4 if symbol != THREATENED else 1.0
    sizes = np.diff(bounds)
    return np.column_stack([np.ones(len(texts)), np.log1p(totals), totals.sum(axis=1) / np.sqrt(sizes + 16)])


def _feature_rows(texts: list[bytes], stems: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([features(texts[low:high], stems, weights) for low, high in chunks(texts)])


def _prefix_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per prefix: toxic documents of the batch that have a word with it, and the evidence of toxic and of other ones."""
    texts, toxic = _lower(as_bytes(batch.column("text"))), batch.column("toxic").to_numpy(zero_copy_only=False)
    seen = []
    for low, high in chunks(texts):
        _, bounds, *heads = word_hashes(texts[low:high], NOT_ALPHANUMERIC, False, PREFIXES)
        owners = owner_of(bounds)
        for values in heads:
            pairs = np.stack([values, owners.astype(np.uint64) + np.uint64(low)], axis=1)[values != 0]
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)])
            times = np.diff(new, append=len(pairs))
            seen.append(np.column_stack([pairs[new], np.rint(PARTS * np.log2(1 + times)).astype(np.uint64)]))
    pairs = np.concatenate(seen)
    prefixes, inverse = np.unique(pairs[:, 0], return_inverse=True)
    bad = toxic[pairs[:, 1].astype(np.int64)]
    sums = (bad, bad * pairs[:, 2], (1 - bad) * pairs[:, 2])
    yield pa.RecordBatch.from_arrays(
        [pa.array(prefixes.view(np.int64)), *[pa.array(np.bincount(inverse, x, minlength=len(prefixes)).astype(np.int64)) for x in sums]],
        ["prefix", "documents", "toxic", "other"])


def learned_stems(fit: DataFrame, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of all prefixes that speak for toxicity; fit is (text, toxic), FIT_ROWS rows at most."""
    counts = (per_batch(fit, _prefix_counts, "prefix long, documents long, toxic long, other long").groupBy("prefix")
              .agg(F.sum("documents").alias("documents"), (F.sum("toxic") / PARTS).alias("toxic"), (F.sum("other") / PARTS).alias("other"))
              .where(F.col("documents") >= LEAST_TOXIC))
    counts = materialise(counts, "prefixes")
    p, n = toxic / (toxic + other), F.col("toxic") + F.col("other")
    ratio = (F.col("toxic") * F.log(F.col("toxic") / n / p)
             + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / n / (1 - p))).otherwise(0.0))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    least = EVIDENCE + math.log(max(1, counts.count()))
    rows = (counts.select("prefix", ratio.alias("ratio"), weight.alias("weight")).where((F.col("ratio") >= least) & (F.col("weight") >= 2))
            .select("prefix", "weight").collect())
    return np.array([r["prefix"] for r in rows], np.int64).view(np.uint64), np.array([r["weight"] for r in rows])


def _regress(rows: np.ndarray, labels: np.ndarray, rounds: int = 40, hold: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, held near PRIOR."""
    weights = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + hold * (weights - PRIOR)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + hold * np.eye(len(weights)), slope)
        weights -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return weights


def held_out(doc_id: str = "doc_id"):
    """Rows that no fitting sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """labels: doc_id, toxic (0 or 1)."""
    named = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialise(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    fit = materialise(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic"), "fit")
    found = fit.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, other = int(found["toxic"] or 0), int(found["n"]) - int(found["toxic"] or 0)
    stems, weights = _hashes(INSULTS), np.full(len(INSULTS), 4.0)
    if toxic and other:
        more, own = learned_stems(fit, toxic, other)
        stems, weights = np.concatenate([stems, more]), np.concatenate([weights, own])
    stems, first = np.unique(stems, return_index=True)
    weights = weights[first]
    if not toxic or not other:
        return Model(stems, weights, PRIOR)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _feature_rows(as_bytes(batch.column("text")), stems, weights)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], ["x", "y"])

    table = per_batch(fit, work, "x array<double>, y double").toArrow()  # FIT_ROWS rows of seven numbers at most
    x = np.array(table.column("x").to_pylist())
    y = table.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # so that sums do not depend on the order of rows
    return Model(stems, weights, _regress(x[order], y[order]))


def _score_column(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    return np.round(model.scores(_feature_rows(as_bytes(batch.column("text")), model.stems, model.weights)), 9)


def score(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _score_column(batch, model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= least).astype(np.int32))],
                                         ["doc_id", "score", "predicted"])

    rows = per_batch(docs.select("doc_id", "text"), work, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def remove_toxic(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below `least`."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pc.less(pa.array(_score_column(batch, model)), least))

    return per_batch(docs, work, docs.schema)
