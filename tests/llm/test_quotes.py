import random
import re

import pytest

from tallywell.llm import quotes


def test_levels_and_paragraphs():
    text = "hello\nOn Monday X wrote:\n> one\n> two\n> \n> three\n> > deep\n>>deeper\nbye\n"
    assert [(level, quotes.paragraphs(lines)) for level, lines in quotes.levels(text)] == [
        (0, ["hello"]), (1, ["one two", "three"]), (2, ["deep deeper"]), (0, ["bye"])]
    assert quotes.unquoted(text) == "hello\nbye" and quotes.unquoted("> only") == "" == quotes.unquoted("")


def brute_force(rows):
    """Parents, roots and counts by looking through all messages."""
    said = {}
    for c, p, text in rows:
        for level, lines in quotes.levels(text or ""):
            if level == 0 and c is not None and p is not None:
                for x in quotes.paragraphs(lines):
                    said.setdefault((c, x), []).append(p)
    stats = {}
    for c, p, text in rows:
        own = stats.setdefault((c, p), [0, 0, {}])
        minimum = {}
        for level, lines in quotes.levels(text or ""):
            for x in quotes.paragraphs(lines):
                if level:
                    minimum.setdefault(x, [level, 0, 0])
                    minimum[x] = [min(minimum[x][0], level), minimum[x][1] + len(x.split(" ")), minimum[x][2] + 1]
        for x, (level, words, n) in minimum.items():
            own[0] += n
            origin = min(said.get((c, x), []), default=None) if c is not None else None
            if origin is not None and p is not None and origin < p:
                own[1] += n
                if level == 1:
                    own[2][origin] = own[2].get(origin, 0) + words
    parent = {k: max((w, o) for o, w in v[2].items())[1] if v[2] else None for k, v in stats.items()}
    result = []
    for c, p, text in rows:
        at, depth = p, 0
        while parent[c, at] is not None:
            at, depth = parent[c, at], depth + 1
        counts = stats[c, p][:2] if c is not None and p is not None else (0, 0)
        result.append((c, p, parent[c, p], at, depth, *counts, quotes.unquoted(text or "")))
    return sorted(result, key=str)


def mails(seed):
    r, rows = random.Random(seed), []
    for c in range(12):
        bodies = []
        for p in range(r.randrange(1, 14)):
            own = "\n".join(" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 6))) + r.choice(["", "\n"])
                            for _ in range(r.randrange(1, 4)))
            if bodies and r.random() < 0.8:
                quoted = r.choice(bodies)
                own = "X wrote:\n" + re.sub("(?m)^", r.choice(["> ", ">", " > "]), quoted) + "\n" + own
            bodies.append(own)
            rows.append((c, p * r.randrange(1, 3) if p == 1 else p * 3, own))
    return rows + [(50, 0, None), (50, 1, ""), (50, 2, "> nobody said this"), (None, 1, "> a"), (None, None, "b"), (60, None, "> b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = mails(seed)
    messages = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conversation long, position long, text string, digest string, level int")
    found = quotes.reply_order(messages)
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows)


def test_quoted_turns_come_back(spark):
    r, turns = random.Random(4), []
    for c in range(20):
        for p in range(r.randrange(1, 9)):
            turns.append((c, p, f"turn {c} {p}\nline {r.random()}" if r.random() < 0.9 else None))
    table = spark.createDataFrame(turns, "conversation long, position long, text string")
    found = {(x["conversation"], x["position"]): x for x in quotes.reply_order(quotes.with_quotes(table)).collect()}
    for c, p, text in turns:
        row = found[c, p]
        assert row["clean_text"] == (text or "")
        before = next((t for a, b, t in turns if (a, b) == (c, p - 1)), None)
        assert row["parent"] == (p - 1 if before else None)
    assert all(x["n_linked"] == x["n_quotes"] for x in found.values())


def test_long_chain(spark):
    table = spark.createDataFrame([(1, p, f"message number {p}") for p in range(70)], "conversation long, position long, text string")
    found = quotes.reply_order(quotes.with_quotes(table)).orderBy("root_position", "depth", "position").collect()
    assert [(x["root_position"], x["depth"]) for x in found] == [(0, p) for p in range(70)]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conversation long, position long, text string")
    assert quotes.reply_order(quotes.with_quotes(table)).count() == 0
