import math
import re
from collections import Counter

import numpy as np
import pytest

from detlake.llm import lexical

DOCS = "doc_id bigint, text string, item_id int, score string, rank int, term string, code int, tie int, n int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _plain(docs, items, top=50):
    """Every document scored for every item."""
    bags = [(d, Counter(WORD.findall(_lower(t or "")))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        terms = {t for i, text in items if i == item for t in WORD.findall(_lower(text or ""))}
        rows = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            rows += [(score, d)] if score > 0 else []
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        out += [(item, k + 1, d, s) for k, (s, d) in enumerate(rows[:top])]
    return sorted(out, key=repr)


def _search(spark, docs, items, top=50, parts=4):
    frame = spark.createDataFrame([(d, t, 0, "clash", 1, "x", 2, 3, 4) for d, t in docs], DOCS).repartition(parts)
    found = lexical.search(frame, spark.createDataFrame(items, "item_id int, text string"), top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_scoring_every_document(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = [f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 60_000)]
    docs, at = [], 0
    for d in range(900):
        n = int(rng.integers(1, 80))
        docs.append((d, " ".join(word[at:at + n])))
        at += n
    docs += [(1000 + d, docs[7][1]) for d in range(120)]  # ties, more than are asked for
    items = [(i, " ".join(word[at + 20 * i:at + 20 * i + 20])) for i in range(25)] + [(30, docs[7][1].upper())]
    monkeypatch.setattr(lexical, "CHUNK", 200)
    monkeypatch.setattr(lexical, "ITEMS", 11)  # several blocks of items
    assert _search(spark, docs, items) == _plain(docs, items)
    assert _search(spark, docs, items[:3], top=7) == _plain(docs, items[:3], 7)


def test_blocks_are_skipped_and_summaries_bound_their_documents():
    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 2**60, 6).astype(np.uint64)) for _ in range(40)]
    vocabulary = np.unique(np.concatenate(terms))
    asked, weights = lexical.Asked(terms, vocabulary), rng.integers(1000, 9000, len(vocabulary))
    per_doc = [np.sort(rng.choice(len(vocabulary), 12, False)).astype(np.int32) for _ in range(600)]
    term, size = np.concatenate(per_doc), np.full(600, 12)
    impact = rng.integers(1, 10**6, len(term)).astype(np.int32)
    import pyarrow as pa

    batch = lexical._chunk(pa.array(range(600)), term, impact, size, asked.near)
    kinds = dict.fromkeys(lexical._BINARY, np.int32) | {"summary": np.uint8}
    stored = {c: np.frombuffer(batch.column(c)[0].as_buffer(), k) for c, k in kinds.items()}
    dense = np.zeros((600, len(vocabulary)), np.int64)
    dense[np.repeat(np.arange(600), 12), term] = impact
    at = seen = 0
    for t, n in zip(stored["block_term"], stored["block_size"]):
        near, docs = asked.near(int(t)), stored["block_docs"][seen:seen + n]
        top = stored["summary"][at:at + len(near)].astype(np.int64) * lexical.STEP
        assert (dense[docs][:, near] <= top).all() and (dense[docs, t] > 0).all()
        at, seen = at + len(near), seen + n
    assert seen == len(term)
    best = [lexical._Best(5) for _ in terms]
    scored = lexical._search_chunk(best, asked, weights, pa.array(range(600)), stored)
    again = lexical._search_chunk([b for b in best], asked, weights, pa.array(range(600, 1200)), stored)
    assert again < scored < 600 * len(terms)
    for item, state in zip(asked.items, best):
        want = sorted(((int(s), d) for d, s in enumerate(dense[:, item] @ weights[item]) if s > 0), key=lambda r: (-r[0], r[1]))
        assert [r for r in sorted(state.rows, key=lambda r: (-r[0], r[1])) if r[1] < 600][:2] == want[:2]


def test_edge_rows(spark):
    docs = [(None, "aa bb"), (1, "Aa bb"), (1, "aa cc"), (2, None), (3, ""), (4, "-- !"), (5, "ÄÖ aa " * 30000), (6, "\x00aa\x7fbb")]
    items = [(1, "aa bb"), (1, "cc"), (2, None), (3, "zz"), (4, "äö"), (5, "ÄÖ"), (None, "bb"), (7, "aa bb"), (7, "aa bb")]
    assert _search(spark, docs, items, parts=3) == _plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert _search(spark, docs, items, parts=1) == []
