import math
import random
import re

import numpy as np
import pytest

from tallywell.llm import decontaminate
from tallywell.llm.words import word_hashes

from .fixtures import odd_rows, rows_to_docs


def benchmark(seed=1, count=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(250)] + ["the", "of", "and"] * 30
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 70))) + "." + r.choice(["", " It is w7 w9.", "\nw1"])) for i in range(count)]
    return items + [(100, None), (None, "w1 w2 w3"), (101, ""), (102, "..."), (103, items[3][1]), (3, items[4][1])]


def documents(items, seed=2):
    r, rows = random.Random(seed), odd_rows(seed)
    for n in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(0, 300))]
        item = re.findall(r"\S+", items[r.randrange(40)][1])
        kind = n % 5
        if kind == 1:
            item = [w.upper() + "***" for w in item]
        elif kind == 2:
            item = item[: len(item) * 2 // 3]
        elif kind == 3:
            item = [w if r.random() < 0.9 else "zzz" for w in item]
        elif kind == 4:
            r.shuffle(item)
        at = r.randrange(len(words) + 1)
        rows.append((2000 + n, " ".join(words[:at] + item + words[at:])))
    return rows


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute_force(rows, items, threshold=0.5, overlap=0.8):
    """Every passage against every item."""
    known = [(i, t, tokens(t)) for i, t in items if i is not None and t and tokens(t)]
    mean = sum(len(w) for _, _, w in known) / len(known)
    df = {}
    for _, _, w in known:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    found = {}
    for n, (doc, text) in enumerate(rows):
        f = tokens(text)
        for item, body, w in known:
            step = max(16, 1 << (len(w) - 1).bit_length())
            weight = {x: math.log1p((len(known) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
                      for x in set(w)}
            total = sum(weight.values())
            for start in range(0, max(1, len(f) - step), step):
                passage = set(f[start : start + 2 * step])
                score = sum(v for x, v in weight.items() if x in passage) / total
                if score < threshold - 1e-9 or not f:
                    continue
                near = f[max(0, start - step) : start + 3 * step]
                shares = []
                for part in decontaminate.split_item(body):
                    p = tokens(part)
                    k = min(5, len(p))
                    grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
                    there = {tuple(near[i : i + k]) for i in range(len(near) - k + 1)}
                    shares.append(len(grams & there) / len(grams) if grams else 1.0)
                row = (all(s >= overlap for s in shares), round(score, 9), -start, *shares)
                found[n, item] = max(found.get((n, item), row), row)
    return sorted((rows[n][0], item, round(r[1], 6), -r[2], round(r[3], 6), round(r[4], 6), r[0]) for (n, item), r in found.items()
                  if rows[n][0] is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    items = benchmark(seed)
    rows = documents(items, seed)
    docs, bench = rows_to_docs(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated_pairs(docs, bench).where("doc_id IS NOT NULL").collect()
    assert sorted((r[0], r[1], round(r[2], 6), r[3], round(r[4], 6), round(r[5], 6), r[6]) for r in found) == brute_force(rows, items)
    kept = decontaminate.remove_contaminated(docs, bench)
    bad = {r["doc_id"] for r in found if r["contaminated"]}
    assert bad and kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)


def test_shards_of_the_index_agree(spark, monkeypatch):
    items = benchmark(3)
    rows = documents(items, 3)
    docs, bench = rows_to_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contaminated_pairs(docs, bench).drop("score").collect()))
    monkeypatch.setattr(decontaminate, "SHARD", 2000)
    parts = decontaminate.contaminated_pairs(docs, bench)
    # Items that share an id may fall into one shard or not; all others are reported alike.
    assert sorted(map(str, parts.where("item_id <> 3").drop("score").collect())) == [r for r in whole if "item_id=3," not in r]


def test_bounds_are_not_below_scores():
    items = [(i, t) for i, t in benchmark(5) if i is not None and t and tokens(t)]
    frequency = {}
    for _, t in items:
        for h in np.unique(word_hashes([t.lower().encode()], decontaminate.NOT_ALPHANUMERIC)[0]).tolist():
            frequency[h] = frequency.get(h, 0) + 1
    for lists in decontaminate.build_lists(items, frequency, len(items), 30.0):
        assert np.allclose(np.bincount(lists.posted_item, lists.posted_weight), 1)
        for t in range(len(lists.terms)):
            at = slice(lists.begin[t], lists.begin[t + 1])
            for j in range(lists.item_begin[t], lists.item_begin[t + 1]):
                block = lists.posted_item[j] // decontaminate.BLOCK
                assert lists.posted_weight[j] <= lists.block_max[at][lists.block[at] == block][0] <= lists.list_max[t]


def test_split_item():
    assert decontaminate.split_item("What is it? A thing.") == ("What is it?", " A thing.")
    assert decontaminate.split_item("Only one.") == ("Only one.", "") and decontaminate.split_item("") == ("", "")


def test_empty_tables(spark):
    docs, bench = rows_to_docs(spark, odd_rows()), spark.createDataFrame(benchmark(), "item_id long, text string")
    assert decontaminate.contaminated_pairs(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated_pairs(docs, bench.where("false")).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.where("false")).count() == docs.count()
