import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from veilshift.llm.mixing import mix, mixed_documents, op1_mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def targets(sizes, share):
    """sizes: by source. Shares by weight, capped at twice a source's size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out = share * sum(sizes.values()), {}
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
    return out


def brute(rows, share=1.5):
    """(id, size, source size, target, taken, source) of each row; rows that agree in id and size are alike."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = targets(sizes, share)
    out = []
    for s in sizes:
        own = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, size(t)) for i, t, x in rows if x == s)
        passes = math.floor(want[s]) // sizes[s] if sizes[s] else 0
        rest = math.floor(want[s]) - passes * sizes[s]
        for _, known, i, n in own:
            part = min(n, rest)
            rest -= part
            out.append((i if known else None, n, sizes[s], round(want[s], 6), passes * n + part, s))
    return out


def corpus(seed):
    random.seed(seed)
    rows = [(i, " ".join(random.choice("abcdefgh") for _ in range(random.choice([0, 1, 3, 20, 400 if i % 50 == 0 else 7]))), f"s{min(6, int(random.expovariate(0.7)))}") for i in range(300)]
    rows += [(1000 + i, t, s) for i, (t, s) in enumerate([(None, "s1"), ("", "s2"), (None, None), ("a b c", None), (" \t\n", "empty"), (None, "empty"), ("é ü", "ü"), ("x", "Z")])]
    rows += [(None, "no id at all", "s0")] * 5 + [(None, "no id", "s0")] + [(7, "same words here", "rep")] * 40 + [(7, "same words there", "rep")] * 11
    return rows


@pytest.mark.parametrize("share", [1.5, 0.4, 2.0, 5.0])
def test_equals_brute_force(spark, share):
    rows = corpus(int(share * 10))
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, source string, mx_size string, mx_at int").repartition(5)
    got = mix(docs, share=share).collect()
    assert sorted(((r.mx_id, r.mx_size, r.mx_source_size, round(r.mx_target, 6), r.mx_taken) for r in got), key=repr) == sorted((r[:5] for r in brute(rows, share)), key=repr)
    again = mix(docs.repartition(3), share=share).collect()
    assert Counter(got) == Counter(again)


def test_texts_are_taken_as_counted(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, `mx_row` string, `a.b` int")
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[(r.doc_id, r.source)] += size(r.text)
        assert rows[r["a.b"]][0] == r.doc_id and (" ".join(WORDS.findall(rows[r["a.b"]][1] or ""))).startswith(" ".join(WORDS.findall(r.text or "")))
    want = Counter()
    for i, _, _, _, taken, s in brute(rows):
        want[(i, s)] += taken
    assert +words == +want
    assert sum(1 for r in got.collect() if not size(r.text)) == sum(not size(t) for _, t, _ in rows)


def test_empty_and_wordless(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a"), (None, "", None)], "doc_id bigint, text string, source string")
    assert {(r.mx_taken, r.mx_target) for r in mix(blank).collect()} == {(0, 0.0)} and mixed_documents(blank).count() == 3
    blank.write.parquet(f"{tmp_path}/documents.parquet")
    assert op1_mixing(spark, str(tmp_path)).columns == ["doc_id", "size", "source_size", "target", "taken"]
