import random
import re

import numpy as np
import pytest

from veilshift.llm import neardup as N
from veilshift.llm.components import components
from veilshift.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted(((i, len(s), i if not s else least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=repr)


def corpus():
    random.seed(7)
    word = lambda: random.choice("abcdefghijklmnop") + str(random.randint(0, 400))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "É one", "é one", "a b c d e", "A B c d E"]
    for _ in range(12):  # near copies at all distances
        base = [word() for _ in range(random.randint(6, 120))]
        for _ in range(random.randint(2, 14)):
            copy = list(base)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: random.choice([None, None, -1, -3])]))
    line = " ".join(word() for _ in range(12))
    texts += [f"{line}\n" + " ".join(word() for _ in range(random.randint(0, 6))) for _ in range(40)]  # a frequent line
    texts += ["w x y z v " * 3000, "w x y z v " * 3000, "w x y z v " * 2999]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, "lone words here"), (None, None), (8, texts[-1]), (8, texts[-1])]
    return rows


@pytest.mark.parametrize("hot", [5000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    if hot == 2:  # salted, with joins for broadcasts, many ranges, and rounds of chains
        for name, value in (("HELD", 0), ("KEYS", 0), ("RANGE", 500), ("FEW", 0), ("PAIRS", 0)):
            monkeypatch.setattr(N, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, node int, n int")
    got = sorted(((r.doc_id, r.nd_shingles, r.nd_component) for r in N.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(rows)
    kept = N.one_of_each(docs.withColumnRenamed("n", "nd_key")).collect()
    want = {}
    for i, n, c in brute_components(rows):
        want.setdefault(c if n else ("none", i), []).append(i)
    assert sorted((r.doc_id for r in kept if brute_set(r.text)), key=repr) == sorted((c for c in want if not isinstance(c, tuple)), key=repr)
    assert sum(not brute_set(r.text) for r in kept) == sum(not brute_set(t) for _, t in rows)
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_sets_of_hashes():
    texts = [t for _, t in corpus()]
    assert [len(s) for s in shingle_sets([t or "" for t in texts])] == [len(brute_set(t)) for t in texts]
    a, b = (np.arange(n, dtype=np.uint64) << np.uint64(54) for n in (8, 10))
    assert N.linked(a, b) and not N.linked(a[:7], b)
    assert N.prefix_length(1) == 1 and N.prefix_length(10) == 3 and N.prefix_length(100) == 21


def test_components(spark):
    random.seed(1)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for l in links for x in l}
    for u, v in links * 70:
        label[u] = label[v] = min(label[u], label[v])
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: y for x, y in label.items() if x != y}
