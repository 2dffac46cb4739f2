import re
from collections import Counter

import numpy as np
import pytest

from detlake.llm import collocations

DOCS = "doc_id bigint, text string, lang string, times int, body int, chunk string, phrase string, n int, salt int"


def _plain(rows, least, top=2000):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {g: a for g, a in count.items() if len(g[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                if 100 * a >= 80 * count[part]:
                    covered.add(part)
    out = []
    for lang in {g[0] for g in cands}:
        rows = []
        for (own, w), a in cands.items():
            if own == lang and (own, w) not in covered:
                cuts = [(2_000_000 * a // (count[own, w[:k]] + count[own, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(w).encode(), count[own, w[:k]], count[own, w[k:]]))
        rows.sort()
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


def _mined(spark, rows, parts=4, **kw):
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "x", "y", 3, 4) for i, (t, lang) in enumerate(rows)], DOCS).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(docs, **kw).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = np.array([*"abcdefgh", "Ä", "ñu", "X1", "aa", "ab", "-"])
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for d in range(400):
        w = rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum())
        rows.append(("".join(x + rng.choice([" ", "  ", "\t", ". ", "\n", " ,"], p=[.7, .1, .05, .05, .05, .05]) for x in w), ["en", "de", None, "und"][d % 4]))
    passage = " ".join(f"p{int(x)}" for x in rng.integers(0, 30, 120))
    return rows + [(f"q{i} {passage}.", "en") for i in range(40)] + [rows[5]] * 50


def test_equals_counting_every_phrase(spark, corpus):
    got = _mined(spark, corpus)
    assert got == _plain(corpus, 30) and len(got) > 40
    assert _mined(spark, corpus, top=5) == _plain(corpus, 30, 5)


def test_one_partition_and_many_agree_and_full_tasks_send_early(spark, corpus, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "LONGEST", 8)
    assert _mined(spark, corpus, parts=1) == _mined(spark, corpus, parts=9) == _plain(corpus, 30)


def test_bodies_hold_every_word_once_and_copies_are_one_chunk(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "x", "y", 3, 4) for i, (t, lang) in enumerate(corpus)], DOCS)
    chunks = collocations.dictionary(docs)
    words = sum(len(re.findall(r"[^ \t.,;:!?\x0A-\x0D]+", t)) for t, _ in corpus)
    assert chunks.selectExpr("sum(times * body)").first()[0] == words
    copies = collocations.dictionary(docs.filter("doc_id = 5")).agg({"body": "sum"}).first()[0]
    many = spark.createDataFrame([(i, corpus[5][0], corpus[5][1], 1, 2, "x", "y", 3, 4) for i in range(50)], DOCS)
    assert collocations.dictionary(many).agg({"body": "sum"}).first()[0] == copies


def test_edge_rows(spark):
    rows = [(None, "en"), ("", "en"), (" .,\n", None), ("a b " * 60, ""), ("a b", None), ("one", "de"), ("w " * 20000, "x"), ("A\x0bB a", "y")] + [("k l m n o", None)] * 31
    assert _mined(spark, rows) == _plain(rows, 30)
    assert _mined(spark, [], parts=1) == []
    assert _mined(spark, [(None, None)], parts=1) == []
