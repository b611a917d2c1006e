import itertools
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, words

from vspark.llm import near_dedup as N


def shingles(text):
    w = text.lower().split()
    return Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else Counter([tuple(w)])


def brute(rows):
    """Classes by comparing all pairs."""
    rows = [(i, t) for i, t in rows if t is not None]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or a.split() and b.split() and sum((shingles(a) & shingles(b)).values()) >= 0.8 * sum((shingles(a) | shingles(b)).values()):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(f"e{seed}_{k}" if rng.random() < share else w for k, w in enumerate(text.split()))


def test_classes_against_all_pairs(spark):
    rows, i = [], 0
    for g in range(25):
        base = words(g, 30 + 15 * g)
        for k in range(1 + g % 6):
            rows.append((i, base if k == 1 else edited(base, 100 * g + k, 0.02 * k) if k else base))
            i += 1
    shared = words(999, 20)
    rows += [(i + k, shared + " " + words(2000 + k, 150)) for k in range(20)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, [(a, b, "en", "s") for a, b in rows])).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [3, 1000])
def test_large_group_in_blocks(spark, block):
    base = words(5, 80)
    rows = [(k, edited(base, k, 0.01 * (k % 5))) for k in range(40)] + [(100 + k, base) for k in range(30)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, [(a, b, "en", "s") for a, b in rows]), block=block).collect()}
    assert got == brute(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = N._mixed(np.arange(60, dtype=np.uint64) + np.uint64(7))
    for share in (0.3, 0.8):
        a = rng.uniform(0.1, 3, 60)
        b = np.where(rng.random(60) < share, a, rng.uniform(0.1, 3, 60))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (N.dart_signature(elements, a, 4096) == N.dart_signature(elements, b, 4096)).mean()
        assert abs(same - true) < 0.04
    few = N.dart_signature(elements[:1], np.array([0.5]))
    assert np.isfinite(few).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.u: r.root for r in N.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: root(i) for i in parent if root(i) != i}


def test_odd_rows(spark):
    docs = documents(spark, ODD, extra=True)
    got = sorted(((r.doc_id or 0), r.class_id) for r in N.near_duplicates(docs).collect())
    assert got == [(0, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7)]
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert N.near_duplicates(docs.filter("false")).collect() == []


def test_rows_without_or_of_one_doc_id(spark):
    a, b, c, d = (words(k, 60) for k in range(4))
    rows = [(None, a), (None, a), (None, b), (None, edited(b, 1, 0.01)), (7, edited(b, 2, 0.01)), (8, c), (8, d), (9, edited(d, 3, 0.01)), (8, c), (10, None), (10, None), (None, None)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=True)
    kept = N.one_of_each_class(docs)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and Counter(texts) == Counter([(None, a), (7, rows[4][1]), (8, c), (8, d), (10, None), (None, None)])
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicates(docs).collect())
    assert got == Counter([(None, None)] * 3 + [(None, 7)] * 2 + [(7, 7)] + [(8, 8)] * 3 + [(9, 8)] + [(10, 10)] * 2)
    assert N.one_of_each_class(docs.filter("false")).collect() == []


def test_pipeline_keeps_documents_without_doc_id(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [(1, words(1, 30), "en", "s"), (None, words(2, 30), "en", "s")])
    assert corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 2


def test_text_doc_ids(spark):
    rows = [("b", words(1, 60)), ("a", edited(words(1, 60), 1, 0.01)), ("c", words(2, 60)), (None, words(2, 60)), ("d", None), (None, None), ("", "x y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicates(docs).collect())
    assert got == Counter([("b", "a"), ("a", "a"), ("c", "c"), (None, "c"), ("d", "d"), (None, None), ("", "")])
    assert Counter(r.doc_id for r in N.one_of_each_class(docs).collect()) == Counter(["a", "c", "d", None, ""])
    dated = docs.selectExpr("date_add(date'2020-01-01', length(text)) AS doc_id", "text")
    assert N.near_duplicates(dated).count() == len(rows)


@pytest.mark.parametrize("block", [2, 250])
def test_chains_and_unlike_texts_in_large_buckets(spark, block):
    """Texts that share two thirds with each other and no more, chains of neighbours at 0.8, and a group around one of them."""
    base, rows = words(7, 200).split(), []
    for k in range(30):
        own = words(5000 + k, 60).split()
        rows.append((k, " ".join(base[:140] + own)))
    text = words(8, 150).split()
    for k in range(25):
        text = text[:]
        text[(k * 6) % 150] = f"c{k}"
        rows.append((100 + k, " ".join(text)))
    rows += [(200 + k, edited(rows[3][1], 77 + k, 0.005)) for k in range(15)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, [(a, b, "en", "s") for a, b in rows]), block=block).collect()}
    assert got == brute(rows)


def test_leaders_leave_nothing_out(spark):
    """Every link that full comparison of the buckets finds joins the same nodes as leaders and open parts do."""
    rng = np.random.default_rng(9)
    for size in (1, 2, 5, 40):
        sets = []
        for _ in range(size):
            cells = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
            sets.append(cells)
        pairs = list(N.linked(sets, None, 0.6))
        slow = [(i, j) for i, j in itertools.combinations(range(size), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))]
        join = lambda links, n=size: [min(x) for x in _parts(links, n)]
        assert join(pairs) == join(slow)
        assert all(N.similar(sets[i], sets[j], 0.6) == ((i, j) in slow) for i, j in itertools.combinations(range(size), 2))
        names = [i % 3 for i in range(size)]
        known = [(i, j) for i, j in itertools.combinations(range(size), 2) if names[i] == names[j]]
        assert join(list(N.linked(sets, None, 0.6, names)) + known) == join(slow + known)


def _parts(links, n):
    at = list(range(n))
    for _ in range(n):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return [[k] for k in at]


def test_recall_on_copies_with_edited_words(spark):
    """Five words and 0.8: a copy with a share p of its words replaced keeps about (1 - p) ** 5 of its stretches, so that 0.8 is left up to some 2 %; all that reach 0.8 are found."""
    rng = np.random.default_rng(3)
    rows, planted = [], {}
    for k in range(120):
        text = words(3000 + k, int(rng.integers(80, 400)))
        share = (0.01, 0.02, 0.03, 0.05)[k % 4]
        copy = edited(text, 900 + k, share)
        a, b = shingles(text), shingles(copy)
        planted[k] = share, sum((a & b).values()) >= 0.8 * sum((a | b).values())
        rows += [(2 * k, text, "en", "s"), (2 * k + 1, copy, "en", "s")]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, rows)).collect()}
    caught = {k: got[2 * k] == got[2 * k + 1] for k in planted}
    assert caught == {k: near for k, (_, near) in planted.items()}
    rate = lambda share: np.mean([caught[k] for k in planted if planted[k][0] == share])
    assert rate(0.01) > 0.9 and rate(0.05) < 0.2
