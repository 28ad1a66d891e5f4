import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veilshift.llm import quality as Q

CLASS = " \t\n\v\f\r"


def words(t):
    out = [""]
    for c in t or "":
        if c in CLASS:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute_counts(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))


def brute_model(texts):
    """Modified Kneser-Ney by its definition: a function from (context of 3, character) to a probability."""
    fold = lambda c: max(3, ord(c)) if ord(c) < 0xE000 else 0xE000 + ord(c) % 0x1900
    counts = {4: Counter()}
    seqs = []
    for t in texts:
        s = [1, 1, 1, *map(fold, t), 2]
        seqs.append(s)
        counts[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(1, 5)]
        out = []
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if all(n[:3]) else 0
            out.append(d if all(n[:3]) and 0.01 < d < k else k / 2)
        return out

    D = {k: discounts(c) for k, c in counts.items()}
    by = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]][g[-1]] = n

    def p(h, w):
        k = len(h) + 1
        low = p(h[1:], w) if h else 1 / (len(counts[1]) + 1)
        follow = by[k].get(h)
        if not follow:
            return low
        total = sum(follow.values())
        off = sum(D[k][min(n, 3) - 1] for n in follow.values())
        n = follow.get(w, 0)
        return (n - (D[k][min(n, 3) - 1] if n else 0)) / total + off / total * low

    return lambda t: sum(math.log(p(tuple(s[i - 3 : i]), s[i])) for s in [[1, 1, 1, *map(fold, t), 2]] for i in range(3, len(s)))


TEXTS = ["abra cadabra " * 4, "", "a b\nc d\n a b\na b\nc d", "é x y # <|> \U0001F600 *" * 3, "one two three four five six seven eight " * 3, "x" * 3000, "\n\n \t", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]


def test_base_counts():
    random.seed(2)
    texts = TEXTS + ["".join(random.choice("ab \n#") for _ in range(300)) for _ in range(40)]
    got = Q.base_counts(texts, *Q.points(texts))
    assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, lp string")


def test_model_equals_its_definition(spark):
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("abcd e") for _ in range(200)) for _ in range(10)]
    log = brute_model(texts)
    arrays = Q._arrays(Q.model(Q.count_grams(table(spark, texts), "lang", "text")))["en"]
    for t in [*texts, "zebra unseen", "abz", "\U0001F601"]:
        g, _ = Q.grams(*Q.points([t]))
        assert int(arrays.log(g).sum()) / Q.MICRO == pytest.approx(log(t), abs=1e-5 * (len(t) + 2))


def test_both_ways_agree_and_bands_reject(spark):
    random.seed(4)
    good = [" ".join(random.choice(["the", "cat", "sat", "on", "mats", "dogs", "ran"]) for _ in range(60)) for _ in range(80)]
    odd = [" ".join("".join(random.choice("bfgjkpqvwxyz") for _ in range(10)) for _ in range(60))]
    rows = table(spark, good + odd + [None, "", good[0], "w " * 30_000]).unionByName(table(spark, good[:5], None))
    a = {(r.doc_id, r.qu_text): r for r in Q.judged(rows.selectExpr("*", "coalesce(lang, '-') as qt").withColumnRenamed("qt", "tag"), ["doc_id", "tag"]).selectExpr("*", "tag as qu_text").collect()}
    b = {(r.doc_id, r.qu_text): r for r in Q.judged(rows.selectExpr("*", "coalesce(lang, '-') as qt").withColumnRenamed("qt", "tag"), ["doc_id", "tag"], model_rows=0).selectExpr("*", "tag as qu_text").collect()}
    assert a == b and len(a) == len(good) + 10
    kept = {k for k, r in a.items() if r.qu_kept}
    assert {(i, "en") for i in range(80)} <= kept and (80, "en") not in kept and (83, "en") in kept
    assert {(i, "-") for i in range(5)} <= kept  # too few for a band
    assert a[81, "en"].qu_base_failed and a[84, "en"].qu_base_failed
    assert Q.good_documents(rows.limit(0)).count() == 0
    kept_rows = Q.good_documents(rows)
    assert kept_rows.columns == rows.columns and kept_rows.count() == len(kept)


def test_word_salad_goes_and_prose_stays(spark):
    random.seed(6)
    parts = ["an", "re", "tion", "th", "er", "ou", "in", "ed", "nd", "es", "ing", "ha"]
    made = lambda: "".join(random.choice(parts) for _ in range(random.randint(2, 4)))
    word = lambda: random.choice(["the", "of", "and", "to", "in"]) if random.random() < 0.5 else made()
    good = [" ".join(word() for _ in range(150)) for _ in range(200)]
    symbols = [" ".join(word() + random.choice(["###", "%%%", "&&&", "$$$"]) for _ in range(150)) for _ in range(4)]
    got = {r.doc_id: r for r in Q.judged(table(spark, good + symbols), ["doc_id"]).collect()}
    assert not any(r.qu_base_failed for r in got.values())
    assert all(got[i].qu_kept for i in range(200)) and not any(got[i].qu_kept for i in range(200, 204))
    counts = Counter(w for t in good + symbols for w in t.split())
    want = -sum(math.log(counts[w] / sum(counts.values())) for w in good[0].split()) / 150
    assert got[0].qu_word_perplexity == pytest.approx(want, abs=1e-3)


def test_scoring_holds_little(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} and more", "en") for i in range(60)], "doc_id bigint, text string, lang string")
    plan = Q.good_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.split("MapInArrow")[-1].split("\n")[1:] if "Project" in line][0]
    assert "qu_row" in sent and "qu_text" not in sent  # a text goes to Python once
    rows = {k: (np.arange(100_000, dtype=np.int64) * 7, np.full(100_000, -5, np.int32), np.full(100_000, -3, np.int32)) for k in (1, 2, 3, 4)}
    held = Q.Arrays(rows)
    assert sum(x.nbytes for of in held.of.values() for x in of) <= 24 * 400_000
    assert held.log(np.array([7, 8], np.uint64), 1).tolist() == [-5, -20_000_000]
    texts = ["ab" * 200_000, None, "x", "y" * 300_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(5)), pa.array(texts)], ["i", "t"]), pa.array(["l"] * 5)], ["qu_row", "qu_lang"])
    parts = list(Q._portions([batch], (1, 0), 1, Q.SCORED))
    assert [x.num_rows for x, _ in parts] == [1, 3, 1] and sum((t for _, (_, t) in parts), []) == texts
