import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from tallywell.llm import licenses
from tallywell.llm.words import NOT_ALPHANUMERIC, owner_of, word_hashes

from .fixtures import lower, odd_rows, rows_to_docs

LINES = ["Released under the MIT License.", "mit license MIT LICENSE", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
         "This work is licensed under the GNU General Public License, version 3.", "general public\nlicense", "mit  (license)", "the licence of mit",
         "apache license mit license apache license", "Lesser General Public License", "cc by sa", "mit", "license", "under the mit"]


def documents():
    rows = odd_rows(5)
    for n, line in enumerate(LINES):
        rows += [(1000 + 3 * n, line), (1001 + 3 * n, f"w1 w2 {line} w3"), (1002 + 3 * n, f"{line}\n{LINES[(n + 5) % len(LINES)]} É")]
    return rows


def statements_in_texts():
    """Every statement whole, cut short, with a word exchanged, and across the border of two documents."""
    rows, i = [], 5000
    for text, key, _ in licenses.TEMPLATES:
        words = text.split()
        for body in (text.upper(), f"w1 {text}. w2", " ".join(words[:-2]), " ".join(words[2:]), " ".join(["w3", *words[1:]]),
                     " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :]), key, f"{key} {key}", " ".join(key.split()[::-1])):
            rows.append((i, body))
            i += 1
    return rows


def brute_force(rows, least=0.6, templates=licenses.TEMPLATES):
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for _, t in rows]
    words = {w for text, _, _ in templates for w in text.split()} | {w for p in licenses.BASE for w in p.split()}
    weight = {w: math.log(1 + (len(files) + 1) / (sum(w in f for f in files) + 1)) for w in words}

    def places(f, phrase):
        return [i for i in range(len(f) - len(phrase) + 1) if f[i : i + len(phrase)] == phrase]

    result = []
    for (doc, _), f in zip(rows, files):
        base = sorted((i, label) for phrase, label in licenses.BASE.items() for i in places(f, phrase.split()))
        named, score = {label for _, label in base}, 0.0
        for text, key, label in templates:
            t, k = text.split(), key.split()
            key_at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for i in places(f, k):
                start = i - key_at
                share = sum(weight[w] for j, w in enumerate(t) if 0 <= start + j < len(f) and f[start + j] == w) / sum(weight[w] for w in t)
                score = max(score, share)
                if share >= least:
                    named.add(label)
        result.append((doc, len(f), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                       ",".join(sorted({x for _, x in base})), ",".join(sorted(named)), round(score, 6)))
    return sorted(result, key=str)


def test_matches_brute_force(spark):
    rows = documents() + statements_in_texts()
    found = licenses.scan(rows_to_docs(spark, rows).repartition(4)).collect()
    assert sorted(((*tuple(r)[:-1], round(r["score"], 6)) for r in found), key=str) == brute_force(rows)


def test_statements_of_the_corpus(spark):
    found = {r["doc_id"]: r for r in licenses.scan(rows_to_docs(spark, list(enumerate(LINES)))).collect()}
    assert [found[i]["labels"] for i in (0, 2, 3, 4)] == ["mit", "apache", "cc-by-nc", "gpl"]
    assert all(found[i]["score"] == 1.0 for i in (0, 2, 3, 4)) and found[10]["labels"] == found[11]["labels"] == ""


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_empty(spark, rows):
    assert [tuple(r)[1:] for r in licenses.scan(rows_to_docs(spark, rows)).collect()] == [(0, 0, None, None, "", "", 0.0)] * len(rows)


def test_many_templates(spark):
    """Generated templates that share words, with keys of one to five words, some of a word that stands twice."""
    r = random.Random(3)
    templates = []
    for n in range(150):
        words = [f"t{min(int(r.expovariate(0.05)), 120)}" for _ in range(r.randrange(5, 25))]
        at = r.randrange(len(words))
        templates.append((" ".join(words), " ".join(words[at : at + r.randrange(1, 6)]), f"label{n}"))
    templates.append(("again and again", "again and again", "twice"))
    rows = [(i, " ".join(r.choice([r.choice(templates)[0], f"t{r.randrange(130)} w", "again and again and again"]) for _ in range(r.randrange(8))))
            for i in range(200)]
    found = licenses.scan(rows_to_docs(spark, rows).repartition(3), templates=templates).collect()
    assert sorted(((*tuple(r)[:-1], round(r["score"], 6)) for r in found), key=str) == brute_force(rows, templates=templates)


@pytest.mark.parametrize("emptied", ["rarest", "second"])
def test_places_come_from_the_index(emptied):
    """Without the postings of either rank no key phrase is found."""
    built = licenses.statements(licenses.BASE, licenses.TEMPLATES)
    vocabulary = np.unique(np.concatenate([s.words for s in built]))
    index = licenses.build_index(built, vocabulary, np.ones(len(vocabulary)))
    words, bounds = word_hashes([b"released under the mit license"], NOT_ALPHANUMERIC)
    none = licenses.Postings(np.zeros(len(vocabulary) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(licenses.standing(index, words, owner_of(bounds))[0]) == 2
    assert len(licenses.standing(replace(index, **{emptied: none}), words, owner_of(bounds))[0]) == 0
