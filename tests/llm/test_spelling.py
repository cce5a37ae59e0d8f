"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonolake.llm import spelling

DOCS = "doc_id long, text string, word string, n long"


def counted(rows):
    total = Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    close = defaultdict(list)
    for a in n:
        for b in n:
            if a < b and near(a, b):
                close[a].append(b)
                close[b].append(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéßÀ") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "colour", "color", "colours", "ÀÈÌÒÙÜ", "àèìòùü"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 200, 900])
        for _ in range(8):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])] * rng.randint(1, 40)
    words += ["z" * 3000] * 6 + ["z" * 2999] * 40 + ["z" * 2999 + "y"] * 300
    words += ["chainaa"] * 8 + ["chainab"] * 60 + ["chaincb"] * 500
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    seps = ["1", "_", "×÷", "Ā", "漢", "K", "\n"]
    return [(None, None), (0, ""), (1, "Ab"), (1, "x " * 500), (None, texts[0]), (7, texts[1]), (7, texts[1])] + [(i - 3, re.sub(" ", lambda _: rng.choice([" ", " ", rng.choice(seps)]), t).swapcase() if i % 5 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("piece", [spelling.PIECE, 3])
def test_variants_are_brute_force(spark, rows, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], DOCS).repartition(3)
    got = spelling.variants(docs).collect()
    want = brute(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got) and any(r.root != r.form for r in got if r.form)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_stretches_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "Wörter und ÀÉ words " * 20 + "x" * 50
    assert [w for part in spelling.runs(text) for w in part] == [w.encode("latin-1").lower() for w in re.findall(r"[A-Za-zÀ-ÿ]+", text)]


def test_one_edit():
    words = ["aab", "aaab", "abab", "abc", "abd", "abcd", "babc", "axbc", "aabb", "baa", "bbaa"]
    cells = {w: np.frombuffer(w.encode().ljust(4, b"\0"), np.uint8) for w in words}
    for a in words:
        for b in words:
            if len(b) - len(a) in (0, 1) and len(a) == 3:
                got = spelling.one_edit(cells[a][None], cells[b][None], np.array([len(b) > len(a)]))[0]
                assert got == near(a, b), (a, b)


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w13" for i in range(13)} | {"a": "w13", "b": "c"}
