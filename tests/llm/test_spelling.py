"""Spelling variants against all pairs of words: edits, ties, roots, odd rows, long words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quietsignal.llm import spelling
from tests.llm.odd import TEXTS, documents, empty


def plain_words(texts, one_in=97):
    total = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(texts, one_in=97):
    words = plain_words(texts, one_in)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def found(docs, one_in=97):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(docs, one_in).collect())


@pytest.mark.parametrize("seed,one_in", [(2, 3), (4, 97)])
def test_variants_against_all_pairs(spark, seed, one_in):
    """Words over three letters, so that groups are full, counts tie and roots are several steps away."""
    r = random.Random(seed)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(4, 8))) for _ in range(60)]
    texts = [(i, " ".join(r.choice(words[: r.randrange(1, 61)]) for _ in range(r.randrange(80))) + " Abéab, ABÉAB") for i in range(80)]
    want = plain_variants(texts, one_in)
    assert found(documents(spark, texts).repartition(5), one_in) == want
    assert any(w[3] and w[5] != w[3] for w in want) and any(w[2] > 3 for w in want)


def test_counts_do_not_depend_on_how_often_tasks_pass_them_on(spark, monkeypatch):
    texts = [(i, "hello hallo hellos " * (i % 5)) for i in range(40)]
    monkeypatch.setattr(spelling, "HELD", 1)
    monkeypatch.setattr(spelling, "BATCH", 3)
    assert found(documents(spark, texts)) == plain_variants(texts)


def test_odd_rows_and_long_words(spark):
    long = "é" * 3_000
    texts = [*TEXTS, *TEXTS, *TEXTS, *[(i, f"{long} {long[:-1]} {long}a") for i in range(3)], *[(20 + i, long) for i in range(6)]]
    assert found(documents(spark, texts), 10**9) == plain_variants(texts, 10**9)
    assert found(empty(spark)) == []


def test_keys_stand_for_the_edited_words():
    for word in ("abc", "aab", "ééé", "x"):
        whole, opened, shorter = spelling.keys_of(word)
        value = lambda s: spelling.keys_of(s)[0]
        assert whole == value(word) and list(shorter) == [value(s) for s in dict.fromkeys(word[:p] + word[p + 1 :] for p in range(len(word))) if s] or word == "x"
        for p, (key, letter) in enumerate(opened):
            assert letter == ord(word[p])
            other = list(spelling.keys_of(word[:p] + "q" + word[p + 1 :])[1])
            assert other[p] == (key, ord("q")) and all(k != key for j, (k, _) in enumerate(other) if j != p)
