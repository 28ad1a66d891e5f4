import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilshift.llm.packing import ByteBpe, assign, pack, tokenizer_path

PUBLIC = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = ByteBpe(tokenizer_path())


def ids(text):
    return PUBLIC.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 1'\n\t é!<|x²\x1c\x85") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_are_those_of_the_public_library(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids(text)


def test_special_text():
    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids(text)


def test_assign_fills_every_sequence():
    random.seed(1)
    lengths = [random.randint(1, 63) for _ in range(500)]
    rows = assign(lengths, 64)
    used, pieces = defaultdict(list), defaultdict(list)
    for p, a, n, s, o in rows:
        used[s].append((o, n))
        pieces[p].append((a, n))
    for parts in [*used.values(), *pieces.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
    assert all(sum(n for _, n in x) == lengths[p] for p, x in pieces.items())
    assert all((t := sum(n for _, n in x)) & (t - 1) == 0 for x in used.values())


def test_pack_covers_all_ids(spark):
    texts = [None, "", "one two", "x " * 3000, "word " * 50, "word " * 50] + [f"text {i} " * (i % 40) for i in range(200)]
    docs = spark.createDataFrame([(i if i != 7 else None, t, "kept out") for i, t in enumerate(texts)], "doc_id bigint, text string, start string")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pack(docs, window=64).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want, at = [*ids(t or ""), 0], 0
        for r in sorted(by_doc[i if i != 7 else None], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    assert pack(docs.limit(0)).count() == 0


def test_few_texts_are_held_at_once():
    import pyarrow as pa

    from veilshift.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(["text"] * 1300)], ["i", "t"])
    parts = list(common.slices([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert [x.num_rows for x in parts] == [512, 512, 276, 3] and pa.Table.from_batches(parts).column("i").to_pylist() == [*range(1300), 5, 6, 7]
