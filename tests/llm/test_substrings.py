import hashlib
import random
from collections import Counter

import pytest

from veilshift.llm import substrings as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (12, 14, 16, 20, 40)]
    texts = [None, "", "short", "a" * 300, "ab" * 100, "xyz" * 333]
    for _ in range(40):
        texts.append(" ".join(random.choice([text(random.randint(0, 12)), random.choice(passages)]) for _ in range(random.randint(1, 6))))
    texts += [texts[7], texts[8], texts[9][:-1], "q" + texts[9], passages[4][3:], text(2000)]
    texts += [text(3) + passages[2] + text(3) for _ in range(30)]
    return texts


@pytest.mark.parametrize("limit, held", [(8192, 4_000_000), (3, 4_000_000), (8192, 0)])
def test_equals_brute_force(spark, monkeypatch, limit, held):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "HELD", held)
    texts, length = corpus(), 80
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, t int, p int")
    got = sorted(S.removed(docs, length=length).collect())
    want = brute(texts, length)
    assert [tuple(r[1:5]) for r in got] == want
    assert all(r.n_removed == sum(s.b - s.a for s in r.spans) and r.n_spans == len(r.spans) for r in got)


def test_empty(spark):
    assert S.removed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [tuple(r) for r in S.removed(spark.createDataFrame([(None, None), (1, "x" * 400)], "doc_id bigint, text string")).drop("spans", "kept_sha256").orderBy("n_bytes").collect()] == [(None, 0, 0, 0), (1, 400, 0, 0)]


def test_passages_of_over_50_words_at_the_contracts_length(spark):
    random.seed(5)
    text = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passages = [text(51), text(70)[:399], text(70)[:400], text(70)]  # of 356, 399, 400 and 489 bytes
    texts = [f"{text(40)}{a}{p}{b}{text(40)}" for p in passages for a, b in ("(!", "[?")]
    got = sorted(S.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert [tuple(r[1:5]) for r in got] == brute(texts, S.LENGTH)
    assert [r.n_removed for r in got] == [0, 0, 0, 0, 400, 400, 489, 489]
