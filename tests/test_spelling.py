import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np

from phonolake.operators import pairs as R
from phonolake.operators import spelling as S


def edited(draw, word, letters, most):
    out = list(word)
    for _ in range(draw.randint(0, most)):
        if draw.random() < 0.5:
            out[draw.randrange(len(out))] = draw.choice(letters)
        else:
            out.insert(draw.randrange(len(out)), out.pop(draw.randrange(len(out))))
    return "".join(out)


def test_matched_letters_are_those_of_difflib():
    draw = random.Random(1)
    points = lambda words: np.array([[ord(c) for c in w] for w in words], np.uint16)
    for n in (1, 6, 12, 20, 31, 44, 60):
        for letters in ("ab", "abcdefgh"):
            left = ["".join(draw.choice(letters) for _ in range(n)) for _ in range(200)]
            right = [edited(draw, w, letters, 4) for w in left]
            want = [sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in zip(left, right)]
            assert S.matched_letters(points(left), points(right)).tolist() == want


def test_many_small_groups_show_each_pair_once(spark, monkeypatch):
    """Keys dealt to many parts, letters of one, two and four bytes, words of one spelling and two sounds."""
    monkeypatch.setattr(S, "GROUP_KEYS", 8)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 3)
    draw = random.Random(2)
    words = []
    for n, letters in ((6, "ab"), (9, "abñ"), (12, "abœ"), (14, "a\U0001f600"), (17, "abc"), (24, "abœ"), (60, "abcde"), (63, "abcd")):
        base = "".join(draw.choice(letters) for _ in range(n))
        words += [edited(draw, base, letters, 3) for _ in range(25)]
    words = list(dict.fromkeys(words))
    rows = [(i - 40, w, "same" if i % 3 == 0 else w) for i, w in enumerate(words)]
    rows += [(rows[0][0], words[0], "other"), rows[1], (900, words[2], "third"), (901, words[2], "fourth"), (901, words[2], None), (None, words[3], "x")]
    keyed: dict[tuple, set] = {}
    for i, w, s in rows:
        if i is not None and s is not None:
            keyed.setdefault((i, w), set()).add(s)
    want = []
    for (i, a), (j, b) in combinations(sorted(keyed), 2):
        if i < j and len(a) == len(b) and any(s != t for s in keyed[i, a] for t in keyed[j, b]) and SequenceMatcher(None, a, b).ratio() > 0.8:
            want.append((a, b))
    df = spark.createDataFrame(rows, "word_id long, word string, sound string")
    assert len(want) > 100 and sorted(tuple(r) for r in R.near_spelling_pairs(df).collect()) == sorted(want)


def test_words_are_not_paired_row_by_row(spark, capsys):
    """Words of up to 60 letters meet inside tasks: no row for each common key, no comparison in a row-by-row function."""
    words = spark.createDataFrame([(1, "abcdefgh", "a"), (2, "abcdefgi", "b"), (3, "a" * 24, "c")], "word_id long, word string, sound string")
    out = R.near_spelling_pairs(words)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 4 and plan.count("Join") == 1
    assert [tuple(r) for r in out.collect()] == [("abcdefgh", "abcdefgi")]
