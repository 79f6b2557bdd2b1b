"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from frames import frame  # noqa: F401
from tabforge.llm import variants
from tabforge.llm.variants import Spelled, count_words, finished, letter_values, spelling_variants


def plain_counts(rows, drop_every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and len(b) - len(a) <= 1 and (a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:])


def plain_variants(counts):
    form, out = {}, []
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def got(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()), key=lambda r: r[0])


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n int")


def random_counts(seed, size=250):
    r = random.Random(seed)
    out = {}
    while len(out) < size:
        w = "".join(r.choice("abÀÿ") for _ in range(r.randint(6, 9)))
        out[w] = 5 ** r.randint(1, 6) + r.randint(0, 2)
    return out


@pytest.mark.parametrize("limits", [{}, {"SHARD_WORDS": 16, "PASS_BYTES": 256, "TASK_WORDS": 40, "EDITED": 7}])
def test_variants_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(variants, name, value)
    counts = random_counts(1)
    assert got(spelling_variants(words(spark, counts))) == plain_variants(counts)


def test_words_of_documents(spark, frame):
    r = random.Random(5)
    pool = ["letter", "Letters", "lettre", "ÀÉÎÕÜÿ", "Àéîõüÿ", "straße", "strasse", "running", "runing", "short", "a×b÷cdef"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(60)) + ",x1y2") for i in range(200)]
    rows += [(None, "letter letter letter"), (7, None), (8, ""), (9, "日本語 😀 letter"), *rows[:3]]
    counts = plain_counts(rows)
    assert any(len(w) < 6 for w in plain_counts(rows, None)) is False and len(counts) > 8
    counted = count_words(frame(rows), drop_every=199)
    assert {w: n for w, n in counted.collect()} == counts
    assert got(spelling_variants(counted)) == plain_variants(counts)


def test_very_long_words_and_texts(spark, frame):
    long = "abcdefghij" * 3000
    rows = [(1, " ".join([long] * 30)), (2, " ".join([long + "x"] * 6)), (3, " ".join([long[:100] + "z" + long[101:]] * 6)), (4, "word " * 100_000),
            (5, " ".join(["y" + long[:70]] * 5 + [long[:70]] * 25))]
    counted = count_words(frame(rows), drop_every=None)
    result = got(spelling_variants(counted))
    assert result == plain_variants(plain_counts(rows, None))
    assert sum(r[1] is not None for r in result) == 3


def test_empty_vocabulary(spark, frame):
    assert spelling_variants(count_words(frame([]), drop_every=199)).collect() == []
    assert spelling_variants(count_words(frame([(1, "abcdef " * 4)]), drop_every=None)).collect() == []


def test_hash_of_an_edit_is_the_hash_of_the_edited_word():
    pool = ["letter", "aaaaaaa", "ÀÉÎÕÜÿab", "z" * 100]
    spelled = Spelled(pool)
    every = np.arange(len(spelled.points))
    letters = np.array([ord("b"), 0xC0])
    shorter, replaced = spelled.shorter(every), spelled.replaced(every, letter_values(letters))
    for at in every:
        word, i = pool[spelled.word[at]], spelled.place[at]
        assert shorter[at] == Spelled([word[:i] + word[i + 1:]]).hashes()[0]
        for c, letter in enumerate("bÀ"):
            assert replaced[at, c] == Spelled([word[:i] + letter + word[i + 1:]]).hashes()[0]
    assert len(set(finished(np.arange(1000, dtype=np.uint64), np.ones(1000, np.int64)).tolist())) == 1000
