import re

import pytest
import xxhash

from detlake.llm import simhash

LONG = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, a int"


def _print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute(rows):
    prints = [(i, _print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1:]:
            if (p ^ q).bit_count() <= 3:
                root[find(q)] = find(p)
    ids = {}
    for i, p in prints:
        if i is not None:
            ids[find(p)] = min(ids.get(find(p), i), i)
    return sorted(((i, f"{p:016x}", ids.get(find(p))) for i, p in prints), key=str)


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_given_documents(spark, sf_dir):
    from detlake.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(QUERIES["op3_simhash_dedup"](spark, sf_dir)) == _brute(rows)


def test_edges(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A\x0bB  C", "é ü ß d", base, base + " end", base, "x" * 500_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one"), (None, "alone here now")]
    data = [(i, t, None, None, None, "clash", 1) for i, t in rows]
    assert _got(simhash.near_duplicates(spark.createDataFrame(data, LONG))) == _brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], LONG)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("tile", [1000, 8])
def test_close_links_keep_every_group(spark, monkeypatch, tile):
    import random

    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
            p = rng.choice(sorted(prints)) if rng.random() < 0.1 else p
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.close_links(spark.createDataFrame(signed, "fp bigint")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)

    def groups(pairs):
        root = {p: p for (p,) in signed}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for p in root:
            out.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, out.values()))

    all_pairs = [(a, b) for (a,) in signed for (b,) in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert groups((r.a, r.b) for r in links) == groups(all_pairs)


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (2, base + " z"), (2, base + " z"), (None, base), (7, "other words here"), (None, "lone text of none"), (9, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "c", 1) for i, t in rows], LONG)
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(2, base + " z"), (7, "other words here"), (None, "lone text of none"), (9, None)], key=str)
