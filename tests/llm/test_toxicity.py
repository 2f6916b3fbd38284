import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import toxicity as t

from .fixtures import odd_rows, rows_to_docs


def test_grammar_reads_clauses():
    read = t.GRAMMAR.read
    assert read([t.INSULT]) == [t.INSULT]
    assert read([t.TARGET, t.INSULT]) == [t.TARGET, t.DIRECTED]
    assert read([t.TARGET, t.NEGATION, t.INSULT])[-1] == t.NEGATED
    assert read([t.REPORT, t.TARGET, t.INSULT])[-1] == t.REPORTED
    assert read([t.REPORT, t.NEGATION, t.INSULT])[-1] == t.NEGATED
    assert read([t.THREAT, t.TARGET]) == [t.OTHER, t.THREATENED]
    assert read([t.TARGET, t.THREAT]) == [t.TARGET, t.THREATENED]
    assert read([t.NEGATION, t.THREAT, t.TARGET]) == [t.NEGATION, t.OTHER, t.TARGET]
    assert read([t.THREAT]) == [t.OTHER] and read([]) == []


def test_composition_equals_running_one_after_the_other():
    r = random.Random(1)
    for _ in range(500):
        symbols = [r.randrange(6) for _ in range(r.randrange(12))]
        assert t.GRAMMAR.read(symbols) == t.TARGETING.read(t.REPORTING.read(t.NEGATING.read(symbols)))


def given():
    stems, first = np.unique(t._hashes(t.INSULTS), return_index=True)
    return t.Model(stems, np.full(len(stems), 4.0), t.PRIOR)


def test_clauses_count_by_kind():
    model = given()
    texts = ["", "you are an idiot", "you. An idiot", "not an idiot", "she said you idiot", "I will kill you", "kill. you", "STUPIDLY done", "nice"]
    x = t.features([s.encode() for s in texts], model.stems, model.weights)
    kind = {name: 1 + t.KINDS.index(name) for name in t.KINDS}
    assert x[0].tolist() == [1] + [0] * 6 == x[8].tolist()
    assert x[1, kind[t.DIRECTED]] > 0 and x[1, kind[t.INSULT]] == 0
    assert x[2, kind[t.INSULT]] > 0 and x[2, kind[t.DIRECTED]] == 0
    assert x[3, kind[t.NEGATED]] > 0 and x[4, kind[t.REPORTED]] > 0
    assert x[5, kind[t.THREATENED]] > 0 and x[6, kind[t.THREATENED]] == 0 and x[7, kind[t.INSULT]] > 0
    scores = model.scores(x)
    assert scores[1] > scores[3] and scores[1] > scores[4] and scores[0] < 0.5


def plain_features(text, stems):
    """The grammar's rules spelled out for one text; stems: bytes of prefixes to weights."""
    known = {w: symbol for symbol, words in t._SYMBOLS.items() if symbol != t.INSULT for w in words}
    totals, count = dict.fromkeys(t.KINDS, 0.0), 0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        negated = reported = targeted = waiting = False
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", clause):
            count += 1
            data = word.encode()
            weight = max([stems.get(data[:n], 0.0) for n in t.PREFIXES if n <= len(data)], default=0.0)
            symbol = t.INSULT if weight else known.get(word)
            if symbol == t.NEGATION:
                negated = True
            elif symbol == t.REPORT:
                reported = True
            elif symbol == t.TARGET:
                if waiting:
                    totals[t.THREATENED] += 1
                targeted, waiting = True, False
            elif symbol == t.THREAT and not negated and not reported:
                if targeted:
                    totals[t.THREATENED] += 1
                else:
                    waiting = True
            elif symbol == t.INSULT:
                kind = t.NEGATED if negated else t.REPORTED if reported else t.DIRECTED if targeted else t.INSULT
                totals[kind] += weight**2 / 4
    return [1.0, *[np.log1p(totals[k]) for k in t.KINDS], sum(totals.values()) / np.sqrt(count + 16)]


def test_features_equal_the_rules_spelled_out():
    r = random.Random(8)
    given_stems = {w.encode(): r.choice([1.0, 2.5, 4.0]) for w in t.INSULTS} | {b"ab": 3.0, b"abc": 2.0, "é".encode() + b"x": 5.0, b"abcdefghijkl": 7.0}
    words = [*(w for group in t._SYMBOLS.values() for w in group), "abcdefghijklm", "abx", "abcd", "éxy", "plain", "IDIOTS", "Not"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "! ", "\n", ", "]) for _ in range(r.randrange(60))) for _ in range(200)]
    hashes = {name: t.word_hashes([name], t.NOT_ALPHANUMERIC)[0][0] for name in given_stems}
    order = sorted(given_stems, key=lambda name: hashes[name])
    found = t.features([s.encode() for s in texts], np.array([hashes[n] for n in order], np.uint64), np.array([given_stems[n] for n in order]))
    assert np.allclose(found, [plain_features(s, given_stems) for s in texts])


def telling_words(fit):
    """Words of three toxic documents at least that stand 20 times as often in toxic texts as in others."""
    documents, times, size = Counter(), {0: Counter(), 1: Counter()}, Counter()
    for text, toxic in fit:
        words = Counter(re.findall(r"[^\W_]+", text.lower()))
        documents.update(words.keys() if toxic else [])
        times[toxic].update(words)
        size[toxic] += sum(words.values())
    return {w for w, n in documents.items() if n >= 3 and (times[1][w] + 0.5) / size[1] > 20 * (times[0][w] + 0.5) / size[0]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_documents(spark, sf):
    """Some rows are labelled toxic although nothing in them is; what can be found are those with a telling word."""
    folder = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = t.score(docs, t.fit_model(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    telling = telling_words(rows[~rows.held_out][["text", "toxic"]].itertuples(index=False))
    found = rows[rows.held_out]
    open_ = np.array([bool(telling & set(re.findall(r"[^\W_]+", text.lower()))) for text in found.text])
    bad, good = found[(found.toxic == 1) & open_], found[found.toxic == 0]
    share = {"sf0.1": 0.92, "sf0.01": 0.75}[sf]
    assert len(bad) > share * (found.toxic == 1).sum()
    assert bad.predicted.mean() > 0.95
    assert good.predicted.mean() < 0.01
    a, b = bad.score.values[:, None], good.score.values[None]
    assert ((a > b) + 0.5 * (a == b)).mean() > 0.98
    if sf == "sf0.1":
        spanish = found[(found.toxic == 1) & (found.lang == "es")]
        assert spanish.predicted.mean() >= 0.9


def test_fitting_sees_only_its_rows(spark):
    docs = rows_to_docs(spark, [(i, f"good text {i}") for i in range(300)] + [(i, f"vile{i % 7}ness here") for i in range(300, 400)])
    labels = docs.select("doc_id", (F.col("doc_id") >= 300).cast("int").alias("toxic"))
    other = labels.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = t.fit_model(docs, labels), t.fit_model(docs, other)
    assert np.array_equal(first.stems, second.stems) and np.array_equal(first.kinds, second.kinds)
    assert len(first.stems) > len(given().stems)
    found = {r["doc_id"]: r for r in t.score(docs, first).collect()}
    assert all(found[i]["predicted"] == (i >= 300) for i in range(400))


@pytest.mark.parametrize("labels", [[], [(1, None)], [(3, 1)], [(None, 1)]])
def test_without_usable_labels(spark, labels):
    rows = odd_rows() + [(5000, "you idiot, you pathetic loser. you moron")]
    docs = rows_to_docs(spark, rows)
    model = t.fit_model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = t.score(docs, model)
    assert found.count() == len(rows) and found.where("score < 0 OR score > 1 OR score IS NULL OR held_out IS NULL").count() == 0
    kept = t.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == found.where("predicted = 0").count() == len(rows) - 1


def test_empty_table(spark):
    docs = rows_to_docs(spark, [])
    assert t.score(docs, t.fit_model(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0


def test_all_telling_prefixes_are_learned(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(3_000)]
    text = " ".join(words)
    fit = spark.createDataFrame([(text, 1)] * 30 + [("", 0)] * 300, "text string, toxic int")
    stems, weights = t.learned_stems(fit, 30, 300)
    assert len(stems) == len(weights) == len({w[:n] for w in words for n in t.PREFIXES}) > 20_000
