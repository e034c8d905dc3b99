"""Collocations against plain counting, with ranges and shards of every size; the automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, g[i : i + k]) for (lang, g), a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * found[lang, g[i : i + k]]}
    out = []
    for lang in n:
        scored = []
        for (own, g), a in found.items():
            if own == lang and (own, g) not in gone:
                score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def texts():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["École", "ÉTÉ", "Ab", "aB", "naïve\x0b", "\x0cz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [("".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!?"]) for w in r.choices(vocabulary, weights, k=r.randint(0, 90))), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(120)]
    return rows + [(None, "en"), ("", None), (" \t.,;", "fr"), ("hot pair " * 3000, "en"), ("a b c d e. " * 40, "de"), ("x" * 300_000, "de")] + [("same text here", "es")] * 6


@pytest.mark.parametrize("range_words", [2 << 20, 300, 60])
def test_collocations_equal_plain_counts(spark, monkeypatch, range_words):
    borders = collocations.prefix_borders
    monkeypatch.setattr(collocations, "prefix_borders", lambda docs: borders(docs, range_words))
    rows = texts()
    docs = spark.createDataFrame([(t, lang, 5, "a", "g", 9) for t, lang in rows], "text string, lang string, f bigint, word string, gram string, rank int")
    for least, top in ((3, 2000), (2, 11)):
        got = sorted((tuple(r) for r in collocations.collocations(docs, least, top).collect()), key=repr)
        assert got == plain(rows, least, top)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_transducers_give_back_their_grams():
    r = np.random.default_rng(1)
    for size in (1, 5, 3000):
        columns = list(r.integers(0, 9, (4, size)).astype(np.int32))
        symbols = np.concatenate((np.zeros(1, np.uint64), np.sort(r.integers(1, 1 << 62, 8).astype(np.uint64))))
        got, counts = collocations.counted(columns)
        want = Counter(zip(*(c.tolist() for c in columns), strict=True))
        assert list(zip(*(c.tolist() for c in got), strict=True)) == sorted(want) and counts.tolist() == [want[g] for g in sorted(want)]
        table, again, same = collocations.from_transducer(collocations.to_transducer(symbols, got, counts))
        assert all((table[a] == symbols[b]).all() for a, b in zip(again, got, strict=True)) and (same == counts).all()
        _, twice = collocations.counted([np.concatenate((c, c)) for c in got], np.concatenate((counts, counts)))
        assert (twice == 2 * counts).all()


def test_count_automaton_equals_a_dictionary():
    r = random.Random(4)
    for _ in range(60):
        counts = {tuple(r.choices(range(6), k=r.randint(1, 4))): r.choice([3, 3, 3, 2**61, r.randint(1, 99)]) for _ in range(r.randint(1, 200))}
        automaton = collocations.CountAutomaton()
        for gram in sorted(counts):
            automaton.add(gram, counts[gram])
        asked = sorted({tuple(r.choices(range(7), k=r.randint(1, 5))) for _ in range(300)} | set(counts))
        assert automaton.composed(asked) == [counts.get(q) for q in asked]
    alike = collocations.CountAutomaton()
    for a in range(50):
        for b in range(50):
            alike.add((a, b), 7)
    alike.composed([])
    assert len(alike.known) == 2  # equal endings are shared
