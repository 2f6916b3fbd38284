import re

import numpy as np

from tallywell.llm import words

from .fixtures import lower, odd_rows, words_of


def test_equal_words_have_equal_hashes_and_others_differ(monkeypatch):
    monkeypatch.setattr(words, "SLICE", 64)
    texts = [text or "" for _, text in odd_rows()]
    found, bounds, starts, ends = words.word_hashes([t.encode() for t in texts], places=True)
    named = {}
    for i, text in enumerate(texts):
        own = words_of(text)
        assert bounds[i + 1] - bounds[i] == len(own)
        for j, word in enumerate(own):
            at = bounds[i] + j
            assert text.encode()[starts[at] : ends[at]].decode() == word
            assert named.setdefault(word, found[at]) == found[at]
    assert len(set(named.values())) == len(named)


def test_words_of_letters_and_digits():
    for _, text in odd_rows():
        expected = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        found, _ = words.word_hashes([(text or "").encode().lower()], words.NOT_ALPHANUMERIC)
        single = [words.word_hashes([w.encode()], words.NOT_ALPHANUMERIC)[0][0] for w in expected[:50]]
        assert len(found) == len(expected) and list(found[:50]) == single


def test_prefixes_are_hashed_like_words():
    _, _, three, five = words.word_hashes([b"abcdef abc ab"], prefixes=(3, 5))
    assert three[0] == three[1] == words.word_hashes([b"abc"])[0][0] and three[2] == 0
    assert five[0] == words.word_hashes([b"abcde"])[0][0] and five[1] == 0


def test_shingle_sets():
    found, bounds = words.word_hashes([b"a b c a b c", b"", b"a b", b"b a", b"a b c"])
    sets = words.shingle_sets(found, bounds, 3)
    assert [len(s) for s in sets] == [3, 0, 1, 1, 1]
    assert sets[4][0] in sets[0] and sets[2][0] != sets[3][0]


def test_chunks_cover_all_texts():
    texts = [b"x" * n for n in (5, 0, 200, 1, 1)]
    assert list(words.chunks(texts, 10)) == [(0, 2), (2, 3), (3, 5)] and not list(words.chunks([], 10))
    assert np.array_equal(words.owner_of(np.array([0, 2, 2, 3])), [0, 0, 2])
