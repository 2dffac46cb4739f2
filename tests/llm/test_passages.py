import re

import numpy as np
import pytest

from detlake.llm import passages
from detlake.llm.queries import QUERIES

LONG = "doc_id bigint, text string, lang string, source string, n_chars bigint, a int, key string"
SF = "/root/testdata/sf0.01"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, 0, 1, "clash") for r in rows], LONG)


def _words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def _text(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))


def test_compact_windows_against_definition(monkeypatch):
    monkeypatch.setattr(passages, "RUN", 6)
    rng = np.random.default_rng(0)
    for trial in range(60):
        lens = rng.integers(0, 25, rng.integers(1, 5))
        at = np.concatenate([[0], np.cumsum(lens)])
        v = rng.integers(0, 2**63, at[-1]).astype(np.uint64)
        if trial % 3 == 0:
            v = (v >> np.uint64(61)) << np.uint64(40)  # ties
        order = [(int(x) >> 20, i) for i, x in enumerate(v)]
        want = set()
        for r in range(len(lens)):
            for c in range(at[r], at[r + 1]):
                lo, hi = c, c
                while lo > at[r] and order[lo - 1] > order[c]:
                    lo -= 1
                while hi + 1 < at[r + 1] and order[hi + 1] > order[c]:
                    hi += 1
                if hi - lo + 1 >= 6:
                    want.add((c, lo, hi))
        assert set(zip(*[x.tolist() for x in passages.compact_windows(v, at)])) == want


def test_every_exact_repeat_of_fifty_words_is_found(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    first, want = {}, set()
    for r in rows:
        w = _words(r.text)
        grams = {" ".join(w[i:i + 50]) for i in range(len(w) - 49)}
        if any(first.get(g, r.doc_id) != r.doc_id for g in grams):
            want.add(r.doc_id)
        for g in grams:
            first.setdefault(g, r.doc_id)
    found = QUERIES["op9_passages"](spark, SF).collect()
    assert want <= {r.doc_id for r in found} and want
    texts = {r.doc_id: _words(r.text) for r in rows}
    for r in found:  # and each report is a similar pair of passages
        assert r.other_id < r.doc_id
        x, y = texts[r.other_id][r.other_first:r.other_end], texts[r.doc_id][r.first_word:r.end_word]
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        assert len(y) >= 50 and len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_near_repeats_with_edits(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for i in range(40):
        passage = _text(rng, 120).split()
        rows.append((2 * i, " ".join([_text(rng, 60), *passage, _text(rng, 40)])))
        edited = list(passage)
        edited[50 + i % 20] = "edited"
        if i % 2:
            edited.insert(20, "added")
        rows.append((2 * i + 1, " ".join([_text(rng, 30), *edited, _text(rng, 90)])))
        want.add((2 * i + 1, 2 * i))
    found = {(r.doc_id, r.other_id) for r in passages.repeated_passages(_docs(spark, rows)).collect()}
    assert len(found & want) >= 0.9 * len(want) and found <= want


def test_cut_edges(spark):
    rng = np.random.default_rng(6)
    shared, own = _text(rng, 60), _text(rng, 70)
    rows = [
        (1, None), (2, ""), (3, "too short"), (3, "too short"), (4, f"Ünd {own}\n{shared}  tail"), (5, f"head\t{shared.upper()}\n end "),
        (6, shared), (7, _text(rng, 300)), (None, shared), (8, f"{shared} {_text(rng, 49)}"), (9, "x" * 300_000 + " " + shared),
    ]
    docs = _docs(spark, rows)
    kept = passages.cut_repeats(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
    tail = rows[9][1].split(" ", 60)[-1]
    want = [(i, t, 0) for i, t in rows if i in (1, 2, 3, 4, 7, None)]
    want += [(5, "head\tend ", 9), (8, tail, len(tail)), (9, "x" * 300_000 + " ", 300_001)]
    assert got == sorted(want, key=str)
    assert passages.cut_repeats(docs.filter("false")).count() == 0


def test_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    text = _text(rng, 3000)
    whole = passages._windows(pa.array([text]), np.array([1]))
    monkeypatch.setattr(passages, "CUT", 1000)
    monkeypatch.setattr(passages, "OVERLAP", 200)
    parts = passages._windows(pa.array([text]), np.array([1]))
    a, b = ({(k, s >> 32) for k, s in zip(w[0].tolist(), w[2].tolist())} for w in (whole, parts))
    assert a <= b
    spot = parts[2] >> 32
    assert spot.max() > 2900 and spot.min() >= 0


def test_finer_keys_link_what_the_first_holder_hides(spark):
    """Many documents hold a short phrase, a few of them inside a long passage they share."""
    rng = np.random.default_rng(12)
    phrase = _text(rng, 12)
    passage = f"{_text(rng, 22)} {phrase} {_text(rng, 22)}"
    rows = [(i, f"{_text(rng, 40)} {passage if i in (11, 37, 58) else phrase} {_text(rng, 40)}") for i in range(80)]
    docs = _docs(spark, rows)
    assert {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs).collect()} >= {(37, 11)}
    assert {r.doc_id for r in passages.repeated_passages(docs).collect()} == {37, 58}
    finer = {(r.a, r.b) for r in passages.candidate_pairs(docs, sides=True).collect()}
    assert (11, 37) in finer and ((11, 58) in finer or (37, 58) in finer)


def test_exact_repeats_behind_chance_holders(spark):
    """Template-like documents: every exact repeat is found though earlier ones hold all of its parts."""
    rng = np.random.default_rng(21)
    parts = [[_text(rng, 20) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(400):
        passage = [p[k] for p, k in zip(parts, rng.integers(0, 6, 3))]
        rows.append((i, " ".join([_text(rng, 20), *passage, _text(rng, 20)])))
    docs = _docs(spark, rows).repartition(5)
    first, repeats = {}, set()
    for i, text in rows:
        w = text.split()
        grams = {" ".join(w[j:j + 50]) for j in range(len(w) - 49)}
        repeats |= {i} if grams & first.keys() else set()
        first.update((g, i) for g in grams if g not in first)
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert len(repeats) > 150 and found == repeats, (len(found), len(repeats))


def test_both_places_of_a_passage_across_partitions(spark):
    """A later document holds an earlier one's passage twice: both are found whether they share a partition or not."""
    rng = np.random.default_rng(22)
    passage = _text(rng, 80)
    rows = [(1, f"{_text(rng, 30)} {passage} {_text(rng, 30)}"), (2, f"{passage} {_text(rng, 200)} {passage} {_text(rng, 9)}")]
    for docs in (_docs(spark, rows).coalesce(1), _docs(spark, rows[:1]).union(_docs(spark, rows[1:]))):
        found = {(r.doc_id, r.first_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
        assert found == {(2, 0, 80), (2, 280, 360)}


def test_stretches_beside_longer_ones_and_across_insertions():
    rng = np.random.default_rng(23)
    v = rng.integers(0, 2**62, 5000).astype(np.uint64)
    t, a, b, c = v[:96], v[200:400], v[400:600], v[600:800]
    def ranges(x, y):
        return sorted((s, e, f, g) for f, g, s, e, _ in passages.similar_stretches(x, y))

    x = np.concatenate([a, t, b])
    assert ranges(x, np.concatenate([c, t[:56], b[100:130], t[40:]])) == [(200, 256, 200, 256), (286, 342, 240, 296)]
    assert ranges(x, np.concatenate([t, c, t[20:80]])) == [(0, 96, 200, 296), (296, 356, 220, 280)]
    # 94 words with 13 more in the middle: 86 of 107 shingles
    near = passages.similar_stretches(np.concatenate([a, v[:90], b]), np.concatenate([c, v[:43], v[900:917], v[47:90], v[1000:1050]]))
    assert [r[:4] for r in near] == [(200, 290, 200, 303)] and near[0][4] == pytest.approx(86 / 107)
    # what stands before and after in one text only, and twice in the earlier one
    assert ranges(np.concatenate([a, t, b, t[:50]]), np.concatenate([a[:40], t, b[150:]]))[0][0] == 40
    # a text of one line again and again
    line = np.tile(v[:12], 100)
    assert passages.similar_stretches(line, line)[0][:4] == (0, 1200, 0, 1200)
    # long texts with many short runs alike
    words = rng.integers(0, 300, 1000)
    pool = v[words]
    assert passages.similar_stretches(pool, np.concatenate([v[words[::-1]], v[2000:2060]])) is not None


def test_edited_fields_of_templates_are_found(spark):
    """Documents of six templates; later ones hold an earlier field with two words changed (similarity 0.81, others 0.58)."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 30_000, n)]
    frames, fields, rows, planted = [(words(40), words(40)) for _ in range(6)], [], [], set()
    for i in range(300):
        fields.append(words(22))
        rows.append((i, " ".join([*frames[i % 6][0], *fields[i], *frames[i % 6][1]])))
    for i in range(1000, 1120):
        source = int(rng.integers(300))
        field = list(fields[source])
        for p in rng.choice(22, 2, replace=False):
            field[p] = f"z{rng.integers(10**6)}"
        rows.append((i, " ".join([*frames[source % 6][0], *field, *frames[source % 6][1]])))
        planted.add((i, source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = {(r.doc_id, r.other_id): r.similarity for r in passages.repeated_passages(docs).collect()}
    assert len(planted & found.keys()) >= 0.95 * len(planted)
    assert min(found.values()) >= passages.SIMILAR


def test_whole_copies_stand_behind_the_first_document(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    one, two, short = text(120), text(90), text(20)
    rows = [(5, one), (3, one), (9, one), (9, one), (3, two), (7, two), (8, short), (10, short), (11, one + " " + text(60)), (12, None), (None, one)]
    found = {(r.doc_id, r.other_id, r.first_word, r.end_word, r.similarity) for r in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {(5, 3, 0, 120, 1.0), (9, 3, 0, 120, 1.0), (7, 3, 0, 90, 1.0), (11, 3, 0, 120, 1.0)}


def test_comparison_of_repetitive_and_reordered_texts():
    """Whatever is reported is similar and long enough, and a passage copied out of a text is always covered."""
    rng = np.random.default_rng(12)
    for k in range(300):
        x = rng.integers(0, [30, 400, 5000][k % 3], int(rng.integers(60, 400))).astype(np.uint64)
        s = int(rng.integers(0, len(x) - 50))
        part = x[s:s + int(rng.integers(50, len(x) - s + 1))]
        y = np.concatenate([rng.integers(10**6, 10**7, int(rng.integers(0, 200))).astype(np.uint64), part, rng.integers(10**6, 10**7, 80).astype(np.uint64)])
        at = len(y) - 80 - len(part)
        out = passages.similar_stretches(x, y)
        for f, t, a, b, share in out:
            one, two = set(x[f:t].tolist()), set(y[a:b].tolist())
            assert share == pytest.approx(len(one & two) / len(one | two)) and share >= passages.SIMILAR and b - a >= passages.RUN
        assert any(a <= at and at + len(part) <= b for _, _, a, b, _ in out)


def test_shared_minima_told_by_the_windows_are_those_of_a_pass_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE", 1 << 12)  # many slices: documents meet inside of one and across
    rng = np.random.default_rng(8)
    some = [_text(rng, 80) for _ in range(6)]
    docs = _docs(spark, [(i, f"{_text(rng, 90)} {some[i % 6] if i % 3 else ''} {_text(rng, 70)}") for i in range(60)] + [(3, some[0])])
    docs = docs.coalesce(1)  # which documents are linked depends on the slices
    found = passages.candidate_pairs(docs, marks=True).collect()
    assert {(r.a, r.b) for r in found if r.a != r.b} == {(r.a, r.b) for r in passages.candidate_pairs(docs).collect()}
    bits = np.unpackbits(passages._shared_minima(passages._rows(docs)).value)
    places = [r.a for r in found if r.a == r.b]
    assert len(places) == len(set(places)) and sorted(places) == np.flatnonzero(bits).tolist() and places


def test_finer_keys_go_on_for_shared_minima_alone_and_link_the_same(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(passages, "SLICE", 1 << 12)
    rng = np.random.default_rng(31)
    some = [_text(rng, 80) for _ in range(5)]
    docs = _docs(spark, [(i, f"{_text(rng, 150)} {some[i % 5] if i % 2 else ''} {_text(rng, 150)}") for i in range(50)]).coalesce(1)
    told = passages.candidate_pairs(docs, marks=passages.HASHES)
    among = passages._bits(told.filter("a = b"), passages.F.col("a"), passages.HASHES * passages.BITS)
    every, few = (passages.candidate_pairs(docs, True, among=x).collect() for x in (None, among))
    assert {(r.a, r.b) for r in every} == {(r.a, r.b) for r in few} and few
    texts = docs.select("text").toArrow().column(0).combine_chunks()
    sent = [len(passages._windows(pa.array(texts), np.arange(50), True, among=x)[0]) for x in (None, among)]
    assert 0 < sent[1] < sent[0] / 2


def test_windows_that_are_wanted_and_near_ends():
    rng = np.random.default_rng(32)
    at = np.concatenate([[0], np.cumsum(rng.integers(0, 900, 30))])
    v = rng.integers(0, 2**63, at[-1]).astype(np.uint64)
    c, left, right = passages.compact_windows(v, at)
    some, low, high = passages.compact_windows(v, at, passages.RUN, lambda c: c % 3 == 0)
    on = c % 3 == 0
    assert some.tolist() == c[on].tolist()
    for near, ends in ((some - low, (c - left)[on]), (high - some, (right - c)[on])):
        assert np.minimum(near, passages.RUN).tolist() == np.minimum(ends, passages.RUN).tolist() and (near <= ends).all()


def test_a_text_of_many_pairs_is_split_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(33)
    shared = _text(rng, 70)
    first, later = f"{shared} {_text(rng, 20)}", [f"{_text(rng, 30)} {shared}" for _ in range(3)]
    rows = [(a, 10 + k, first, k, later[k]) for k in range(3) for a in range(6)]
    split, own = [], passages.shingles
    monkeypatch.setattr(passages, "shingles", lambda data, at: split.append(len(at) - 1) or own(data, at))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "x", "text_id", "text"])
    out = pa.Table.from_batches(list(passages._verify(iter([batch])))).to_pylist()
    assert sum(split) == 4
    assert [(r["doc_id"], r["other_id"], r["text_id"], r["first_word"], r["end_word"]) for r in out] == [(b, a, k, 30, 100) for a, b, _, k, _ in rows]


def test_nearest_range_is_that_of_a_comparison_of_all():
    rng = np.random.default_rng(34)
    for k in range(200):
        y = rng.integers(0, [20, 90, 4000][k % 3], 160).astype(np.uint64)
        x = np.concatenate([rng.integers(0, 300, 40).astype(np.uint64), y[20:100 + k % 50], y[30:90], rng.integers(0, 300, 40).astype(np.uint64)])
        pair, s, e = passages._Pair(x, y), 20, 80 + k % 30
        likes = {tuple(sorted(map(int, rng.choice(len(x) + 1, 2, replace=False)))) for _ in range(20)} | {(40, 120 + k % 50), (40, 100 + k % 30)}
        share, _, f, t = max((pair.likeness(f, t, s, e), -f, f, t) for f, t in likes)
        assert pair.nearest(likes, s, e, pair.marks(pair.y[s:e])) == ((share, f, t) if share >= passages.SIMILAR else (0, 0, 0))


def test_followers_against_definition():
    rng = np.random.default_rng(35)
    for _ in range(60):
        n, wide, far = int(rng.integers(1, 120)), int(rng.integers(5, 400)), int(rng.integers(1, 60))
        i, j = rng.integers(0, wide, (2, n))
        by = np.lexsort((i, j))
        i, j, long = i[by], j[by], rng.integers(1, 20, n)
        want = []
        for p in range(n):
            apart = {o: max(abs(i[o] - i[p] - long[p]), abs(j[o] - j[p] - long[p])) for o in range(n) if i[o] > i[p] and j[o] > j[p]
                     and i[o] + long[o] > i[p] + long[p] and j[o] + long[o] > j[p] + long[p]}
            near = [(a, o) for o, a in apart.items() if a <= far]
            want.append(min(near)[1] if near else -1)
        assert passages._followers(i, j, long, far) == want
