from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lexspark.functions import fuzzy


def table_of_distances(pattern, text):
    """The least errors of the pattern anywhere in the text, by the plain table."""
    row, least = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p.lower() != c.lower()), row[i] + 1, new[i - 1] + 1))
        row, least = new, min(least, new[-1])
    return least


def test_errors_equal_the_plain_table():
    draw = random.Random(1)
    for pattern in ("a", "ab", "zakon", "abcabca", "x" * 32, "Šuma žito", "abcdefghijklmnopqrstuvwxyzabcdef"):
        letters = pattern[:6] + "xyz Šš"
        texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 9, 40, 200, 700, 1500]))) for _ in range(40)]
        texts += ["y" * 505 + pattern + "y" * 600, "y" * 511 + pattern, None, "", pattern, pattern.upper()]
        own = fuzzy.Texts(texts)
        assert own.errors(own.masks(pattern), len(pattern)).tolist() == [table_of_distances(pattern, t or "") for t in texts]


def test_runs_are_of_two_letters_or_more_of_the_pattern():
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcxyzŠš ") for _ in range(draw.randrange(30))) for _ in range(300)]
    scores, runs, words = fuzzy.matched(texts, "aBcš", 0.7, 2, 3)
    assert words.tolist() == [len(re.findall("[^ ]+", t)) for t in texts]
    for text, score, run in zip(texts, scores, runs, strict=True):
        want = re.findall("[abcŠš]{2,}", text)[:3]
        assert run == want
        errors = table_of_distances("abcš", text)
        assert np.isnan(score) if not want or errors / 4 > 0.7 else score == max(errors / 4, 0.001) or text.lower() == "abcš"


def test_equal_blank_and_long_patterns():
    scores, runs, _ = fuzzy.matched(["zakon", "ZAKON", " ", None, "ne", "zakon o"], "Zakon", 0.7, 2, 3)
    assert scores[:2].tolist() == [0, 0] and np.isnan(scores[2:4]).all() and scores[5] == 0.001
    long = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert fuzzy.parts(long) == [long[:32], long[-32:]] and fuzzy.parts(long[:32]) == [long[:32]] and fuzzy.parts("x" * 64) == ["x" * 32] * 2
    scores, _, _ = fuzzy.matched([long + "!", long[:32], "%%"], long, 0.7, 2, 3)
    assert scores[0] == 0.001 and scores[1] == pytest.approx((0.001 + 4 / 32) / 2) and np.isnan(scores[2])


def test_weights_and_lengths_of_fields():
    scores, marks = fuzzy.weighted([["zakon o lovu", "zakon", None], ["x", "lov zakon", "nista"]], [0.6, 0.4], "zakon", 0.4)
    one = 0.001 ** (0.6 * 0.577)
    assert scores[0] == pytest.approx(one) and scores[1] == pytest.approx(fuzzy.EPSILON**0.6 * 0.001 ** (0.4 * 0.707)) and np.isnan(scores[2])
    assert marks == [["zakon"], ["zakon", "zakon"], []]
