import random
import re

import corpus_pipeline
from test_neardup import brute_set
from veilshift.llm.common import keep

WORD = r"[^\x20\x09-\x0D]+"


def test_stages(spark, tmp_path):
    random.seed(3)
    vocabulary = ["".join(random.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(random.choice(vocabulary) for _ in range(random.randint(30, 90))), "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], "en", "s9", 0) for i in range(10)]  # copies
    rows += [(300 + i, rows[i][1] + " extra", "en", "s9", 0) for i in range(20, 25)]  # near copies
    rows += [(400, "too short", "en", "s1", 0), (401, None, "en", None, 0), (402, "same words here now " * 40, "en", "s1", 0)]
    rows += [(403, " ".join(random.choice(vocabulary) for _ in range(60)) + " token=abcdef123456 " + " ".join(random.choice(vocabulary) for _ in range(10)), "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], str(tmp_path)), "test"))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    _, good, unique, masked, mixed, packed = seen
    text = {r[0]: r[1] for r in rows}
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(good) == sorted(set(text) - {400, 401, 402})
    want = [i for i in ids(good) if not any(j < i and len(brute_set(text[i]) & brute_set(text[j])) >= 0.8 * len(brute_set(text[i]) | brute_set(text[j])) for j in ids(good))]
    assert ids(unique) == want and {200, 320} & set(want) == set()
    of = {r.doc_id: r.text for r in masked.collect()}
    assert sorted(of) == want and "[secret]" in of[403] and all(of[i] == text[i] for i in want if i != 403)
    size = {i: len(re.findall(WORD, t)) for i, t in of.items()}
    got = mixed.collect()
    taken = sum(len(re.findall(WORD, r.text)) for r in got)
    assert abs(taken - 1.5 * sum(size.values())) <= 10 and all(r.n_chars == len(r.text) and of[r.doc_id].startswith(r.text[:5]) for r in got)
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.filter("start = 0").collect())
    assert packed.filter("start = 0").count() == len(got)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_stand_odd_rows(spark, tmp_path):
    random.seed(5)
    vocabulary = ["".join(random.choice("aeioulnrst") for _ in range(5)) for _ in range(200)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(40), "en", f"s{i % 2}", 0, "x", 1, None, "c") for i in range(60)]
    alone = prose(50)
    rows += [(None, alone, None, None, None, None, None, None, None)] * 3 + [(None, None, None, None, None, None, None, None, None)] * 2
    rows += [(7, rows[7][1], "en", "s1", 0, "other", 2, None, "d"), (8, "", "en", "s1", 0, "x", 1, None, ""), (90, prose(30_000), "en", "s0", 0, "x", 1, None, "long")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, qu_lang string, nd_key int, sc_row string, `mx_row` string"
    docs = spark.createDataFrame(rows, schema)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], str(tmp_path)), "odd"))
        if name != "packing":
            assert seen[-1].columns == docs.columns, name
    _, good, unique, masked, mixed, packed = seen
    found = [(r.doc_id, r.text) for r in good.collect()]
    assert found.count((None, alone)) == 3 and {i for i, _ in found} >= {*range(60), 90} and all(t for _, t in found)
    left = [(r.doc_id, r.text) for r in unique.collect()]
    assert left.count((None, alone)) == 1 and sorted(i for i, _ in left if i is not None) == [*range(60), 90]
    assert sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in masked.collect())
    assert packed.filter("start = 0").count() == mixed.count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = keep(stage(spark, none, str(tmp_path)), "none")
        assert none.count() == 0
