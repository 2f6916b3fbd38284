"""Small documents with every odd case, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, key string, label string, id string, digest string"


def rows_to_docs(spark, rows):
    """Documents with extra columns whose names clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "l", "x", "d") for i, t in rows], SCHEMA)


def odd_rows(seed=5, count=60):
    """Texts with copies, near copies, shared passages, ties, repeated rows, nulls, empties and a very long one."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "Été", "straße", "…"]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    passage = prose(40)
    rows, i = [], 0
    for _ in range(count):
        kind, words = r.randrange(6), prose(r.randrange(1, 120))
        if kind == 1 and rows:
            words = (r.choice(rows)[1] or "").split()
        elif kind == 2 and rows:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(max(1, len(words) // 40)):
                if words:
                    words[r.randrange(len(words))] = "edited"
        elif kind == 3:
            at = r.randrange(len(words) + 1)
            words = words[:at] + passage + words[at:]
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(words)))
        i += r.randrange(1, 4)
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \t\n "), (i + 4, "one"), (i + 5, "two words"), (i + 6, "two  words"), (i + 7, "same " * 500),
             (i + 8, "same " * 300), (i + 9, " ".join(prose(30_000))), (i + 10, "\x0bodd\x0cblank \xa0 not blank"), (None, "no id here at all"),
             (None, None), rows[0], rows[0], (i + 11, rows[3][1]), (-5, rows[4][1])]
    r.shuffle(rows)
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
