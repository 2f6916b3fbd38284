import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallywell.llm import spellings

from .fixtures import lower, odd_rows, rows_to_docs


def plain_words(rows, every, least=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near_words(words):
    """All pairs, by the definition."""
    near = defaultdict(set)
    names = sorted(words)
    for a in names:
        for b in names:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                near[a].add(b)
            elif len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    return near


def brute_force(words, ratio=10):
    near, forms = near_words(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    found = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        found.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(found)


def result(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def odd_words(seed):
    """Clusters of neighbours: runs of equal letters, replaced, lost and doubled letters, chains of counts, accents."""
    r = random.Random(seed)
    rows = []
    for base in ("aaaaaaaa", "abababab", "léttersé", "mississippi", "Conversation", "xyzzyxyzzy"):
        spoken = {base: 300}
        for _ in range(25):
            w = r.choice(list(spoken))
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abéÿxs") + w[at:], w[:at] + r.choice("abéÿÀs") + w[at + 1 :]])
            spoken[w] = r.choice([1, 2, 3, 5, 30, 60])
        words = [w for w, n in spoken.items() for _ in range(n)]
        r.shuffle(words)
        rows += [(len(rows) + k, r.choice([" ", "-", "1", "_", " ×"]).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    return rows


@pytest.mark.parametrize("seed, every", [(1, None), (2, 5), (3, 31)])
def test_matches_brute_force(spark, seed, every):
    rows = odd_words(seed) + [(9000, "q" * 30_000 + " " + "q" * 30_000 + "q " + "q" * 30_000), (9001, "q" * 30_001), (None, "abababab"), (None, None)]
    found = spellings.grouped(rows_to_docs(spark, rows), 7, 2, every)
    assert result(found) == brute_force(plain_words(rows, every))


def test_odd_documents(spark):
    rows = [(i, t) for i, t in odd_rows(11) if len(t or "") < 50_000]
    assert result(spellings.grouped(rows_to_docs(spark, rows), 3, 2, 7, 2)) == brute_force(plain_words(rows, 7, 3), 2)


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("backwards", [False, True])
def test_nodes_are_beginnings(spark, parts, backwards):
    """One number per beginning, also where it reaches over the borders of many ranges."""
    r = random.Random(parts)
    names = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(400)} | {"a" * k for k in (20, 30, 31)})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        words = spark.createDataFrame(list(enumerate(names)), "id long, word string")
        found = {row["id"]: row["nodes"] for row in spellings.trie_nodes(words, backwards).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    text_of, node_of = {}, {}
    for i, word in enumerate(names):
        word = word[::-1] if backwards else word
        assert len(found[i]) == len(word) + 1
        for d, node in enumerate(found[i]):
            assert text_of.setdefault(node, word[:d]) == word[:d]
            assert node_of.setdefault(word[:d], node) == node


def test_empty_table(spark):
    assert result(spellings.grouped(rows_to_docs(spark, []))) == []
