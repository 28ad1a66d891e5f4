import math
import random
import re
import zlib

import pytest
from veilshift.llm.toxicity import ANNOUNCEMENTS, BETWEEN, INSULTS, NEGATIONS, PHRASES, REPORTS, RULES, TARGETS, THREATS, Lexicon, _evidence, _ratio, features, fit, op5_toxicity, patterns, score


def symbols(tags):
    return [s for s, _ in RULES.run([(t, 1.0) for t in tags])]


def test_grammar():
    assert symbols("oTI") == ["o", "T", "I+"]
    assert symbols("IoT") == ["I", "o", "L"]
    assert symbols("NooI") == ["N", "o", "o", "I-"] and symbols("NoooI") == ["N", "o", "o", "o", "I"]
    assert symbols("RNTI") == ["R", "N", "T", "I~-+"]


def brute(text, learned):
    """The same features by looking back from every word of every clause."""
    weight = arcs = clauses = links = 0
    marks = dict.fromkeys("-~+", 0)
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        w = re.findall(r"[^\W_]+(?:['\u2019][^\W_]+)*", clause)

        def hit(i):
            longest = max((p for p in learned if w[i].startswith(p)), key=len, default=None)
            between = i - 1
            while between >= 0 and w[between] in BETWEEN:
                between -= 1
            if between >= 0 and f"{w[between]} {w[i]}" in PHRASES:
                return "I", 3.0
            if longest:
                return "I", learned[longest]
            return ("H", 2.0) if w[i] in THREATS else ("I", 3.0) if w[i] in INSULTS else None

        tags = [hit(i) for i in range(len(w))]
        plain = lambda i, words: tags[i] is None and w[i] in words  # noqa: E731, B023
        first = [next((k for k in range(i) if tags[k] or plain(k, TARGETS)), None) for i in range(len(w))]
        clauses += any(tags)
        for i, t in enumerate(tags):
            said = any(plain(k, REPORTS) for k in range(i))
            denied = any(plain(k, NEGATIONS) for k in range(max(0, i - 3), i))
            before = any(plain(k, TARGETS) for k in range(i))
            if t:
                v = t[1] * (1.5 if t[0] == "H" and any(plain(k, ANNOUNCEMENTS) for k in range(max(0, i - 4), i)) else 1)
                for m, on, by in (("~", said, 0.6), ("-", denied, 0.6), ("+", before, 1.2)):
                    marks[m] += on
                    v *= by if on else 1
                weight, arcs = weight + v, arcs + 1
            elif plain(i, TARGETS) and first[i] is not None and any(tags[:i]) and not before:
                links += 1
    return [math.log1p(weight), min(weight, 20.0) / 4, float(arcs >= 1), float(arcs >= 2), float(arcs >= 3), min(clauses, 6) / 3, min(links, 3), *(min(marks[m], 3) for m in "-~+")]


def test_features_equal_a_naive_matcher():
    random.seed(8)
    words = ["you", "they", "not", "never", "said", "will", "gonna", "kill", "hurt", "idiot", "scum", "grueling", "gruel", "piece", "of", "a", "shit", "son", "bitch", "tree", "runs", ".", ":", "\n", "!"]
    learned = {"grue": 4.0, "gruelin": 1.5}
    lexicon = Lexicon(learned)
    for _ in range(600):
        text = " ".join(random.choice(words) for _ in range(random.randint(0, 25)))
        assert features(text, lexicon) == pytest.approx(brute(text, learned)), text


def test_clauses():
    lexicon = Lexicon({"grue": 4.0})
    plain, negated, reported = (features(t, lexicon)[0] for t in ("a grueling thing.", "that is not gruesome.", "she said: so. He wrote grue."))
    assert plain > negated and plain > reported > 0
    assert features(None, lexicon) == features("", lexicon) == features("said. not you", lexicon) and sum(features("", lexicon)) == 0
    assert features("you idiot", lexicon)[0] > features("idiot", lexicon)[0]


def test_patterns_need_evidence():
    assert patterns([("abcd", 20, 1, 10, 0), ("abcde", 18, 1, 9, 0), ("wxyz", 2, 0, 1, 0)], 30, 300).keys() == {"abcd"}


def test_evidence_as_an_expression(spark):
    rows = [(a, b) for a in (0, 1, 4, 20, 30) for b in (0, 1, 9, 150, 300)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", _evidence("a", "b", 30, 300).alias("g")).collect()
    for r in got:
        odds = math.log((r.a + 0.5) / 31) - math.log((r.b + 0.5) / 301)
        want = _ratio(r.a, 30, r.b, 300) if r.a / 30 >= r.b / 300 and odds >= 1.4985 else 0.0
        assert r.g == pytest.approx(want, abs=1e-9)


def test_fit_and_score(spark, tmp_path):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, f"some plain words {i} here.\n" * 5 + ("blorfing zz blorfed qq." if bad else "fine."), "en", "x"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, None, None), (1000, "", "en", "x"), (1000, "", "en", "x"), (1001, "w " * 50_000, "en", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == int(r.score >= 0.5) == int(r.doc_id < 400 and r.doc_id % 8 == 0)
    empty = spark.createDataFrame([], "tx_id bigint, text string, toxic int")
    assert score(empty.withColumnRenamed("tx_id", "doc_id"), fit(empty)).count() == 0


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in op5_toxicity(spark, data).collect() if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in got) / len(got) > 0.9
