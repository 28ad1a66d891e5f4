"""Secret scans with corpus-wide ownership frequency.

One pass finds candidates: fixed patterns, and tokens that look random by their entropy, with less of it where the words
before them speak of a credential. A hash of each candidate's value is aggregated over the corpus by distinct
repositories and owners. Values that many owners share, or many repositories of some owners, are copied
examples; the rest look live. Nothing but hashes and positions is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, documents, keep, slices, whole_row

#: A private key up to its END line, or without one its header fields and lines of base64; group 1 is the body.
PEM = re.compile(
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    r"((?:(?!-----BEGIN )[\s\S])*?(?=-----END (?:[A-Z]+ )*PRIVATE KEY-----)"
    r"|(?:\s*[A-Za-z]+-[A-Za-z]+: [^\n]*\n)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,76}={0,2}(?![^\r\n\\]))?)"
    r"(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"
)
#: White space in a key, also as escapes in a string; the same key wrapped otherwise is the same value.
PEM_SPACE = re.compile(r"\s|\\[nr]")

#: Fixed patterns, by kind and in this order. The first three are the base rules; the second item is the group that
#: holds the secret, the third the least length of it.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("pem", PEM, 1, 0),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("forge", re.compile(r"gh[opsru]_[A-Za-z0-9]{30,}"), 0, 1),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("pay", re.compile(r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0, 1),
    ("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0, 1),
)
#: A token that may be random, and the words before one on its line that speak of a credential.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])")
CONTEXT = re.compile(r"key|token|secret|passw|passphrase|credential|bearer|authorization|private|signature", re.I)
#: Characters before a token that are looked at; least length and bits a character of a token with such words, and without.
BEFORE, NEAR, ALONE = 60, (12, 2.9), (20, 3.6)
KINDS = (*[r[0] for r in RULES], "random")
BASE = 3
#: From so many distinct owners on a value is a copied example.
WIDE_OWNERS = 5
#: So is one of some owners from so many repositories on, without those of the owner that has most: however often one
#: owner repeats its own value, that is no copy.
SOME_OWNERS = 3
WIDE_REPOSITORIES = 25

SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"


def entropy(value: str) -> float:
    """Bits a character, by the value's own counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random(text: str, m: re.Match) -> bool:
    """Letters and digits, in both cases unless the words before speak of a credential, and of enough entropy."""
    value = m[0]
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    near = CONTEXT.search(text[max(0, m.start() - BEFORE) : m.start()].rpartition("\n")[2]) is not None
    length, bits = NEAR if near else ALONE
    return len(value) >= length and (near or value != value.lower() and value != value.upper()) and entropy(value) >= bits


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every candidate, by start and then kind; offsets in code points, end exclusive. A
    random token inside what another rule finds is no candidate of its own."""
    out = []
    text = text or ""
    for k, (_, rule, group, least) in enumerate(RULES):
        for m in rule.finditer(text):
            value = m[group]
            if rule is PEM:  # a header alone is its own value
                value = PEM_SPACE.sub("", value) or m[0]
            if len(value) >= least:
                out.append((m.start(), k, m.end(), value))
    out.sort()
    ends, far = [], 0  # the furthest end of the spans so far
    for a, _, b, _ in out:
        far = max(far, b)
        ends.append((a, far))
    random = []
    for m in TOKEN.finditer(text):
        at = bisect_left(ends, (m.end(), 0))
        if (not at or ends[at - 1][1] <= m.start()) and _random(text, m):
            random.append((m.start(), len(RULES), m.end(), m[0]))
    return sorted(out + random) if random else out


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _scan(docs: DataFrame, row: Column, text_col: str) -> DataFrame:
    """sc_row (of any kind), and sc_assign, sc_access, sc_hex, sc_base and sc_spans (with the hash of each value) of each
    row of docs. Null text: as the empty one, no spans. Repeated rows: alike."""
    rows = docs.select(row.alias("sc_row"), column(text_col).cast("string").alias("sc_text"))
    of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))
    names = ["sc_row", "sc_assign", "sc_access", "sc_hex", "sc_base", "sc_spans"]

    def scan(batches):
        for batch in slices(batches):
            spans = [find(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in x if s[1] < BASE] for x in spans]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(BASE)]
            digests = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
            found = pa.array([[dict(start=a, kind=k, end=b, hash=_digest(v)) for a, k, b, v in x] for x in spans], of)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, found], names)

    return rows.mapInArrow(scan, f"sc_row {rows.schema['sc_row'].dataType.simpleString()}, sc_assign bigint, sc_access bigint, sc_hex bigint, sc_base string, sc_spans array<{SPAN}>")


def _owned(repository: str, owner: str) -> list[Column]:
    """r, o: a row's repository and owner; null ones count as one."""
    return [F.coalesce(column(c).cast("string"), F.lit("\0")).alias(a) for c, a in ((repository, "r"), (owner, "o"))]


def ownership(seen: DataFrame) -> DataFrame:
    """seen: r, o, hash. Returns hash, sc_repositories, sc_owners, sc_wide: how widely each value is copied, however
    often a row repeats it. Only hashes are shuffled, each once for a repository, owner and task. No rows: no rows."""
    # distinct by stages, so that a value in every document is spread over its repositories first
    pairs = seen.select("hash", "o", "r").distinct()
    by_owner = pairs.groupBy("hash", "o").agg(F.count("*").alias("n"))
    by_repo = pairs.groupBy("hash", "r").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("sc_repositories"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("sc_owners"), (F.sum("n") - F.max("n")).alias("sc_elsewhere"))
    some = (F.col("sc_owners") >= SOME_OWNERS) & (F.col("sc_elsewhere") >= WIDE_REPOSITORIES)
    return owners.join(by_repo, "hash").withColumn("sc_wide", (F.col("sc_owners") >= WIDE_OWNERS) | some).drop("sc_elsewhere")


def judged(docs: DataFrame, carry: list[str], text_col: str, repository: str, owner: str) -> DataFrame:
    """A row for each row of docs: the columns of `carry`, sc_assign, sc_access, sc_hex (base spans of each kind),
    sc_base (hash of the base spans) and sc_found: array of (start, kind, end, wide), by start and kind.

    Null and empty texts have no spans. Repeated rows are judged alike. No rows: no rows. Other columns go, and so does a
    column of carry that has one of the names above.
    """
    carry = [c for c in carry if c not in ("sc_assign", "sc_access", "sc_hex", "sc_base", "sc_found")]
    row = F.struct(F.monotonically_increasing_id().alias("number"), *_owned(repository, owner), *[column(c).alias(f"c{k}") for k, c in enumerate(carry)])
    scanned = keep(_scan(docs, row, text_col), "secrets")
    some = scanned.filter(F.size("sc_spans") > 0)
    wide = ownership(some.select("sc_row.r", "sc_row.o", F.explode("sc_spans.hash").alias("hash")))
    spans = some.select("sc_row.number", F.explode("sc_spans").alias("s")).select("number", "s.*").join(wide, "hash")
    found = spans.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "sc_wide"))).alias("sc_found"))  # of one text
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,sc_wide:boolean>>")
    with_spans = some.withColumn("number", F.col("sc_row.number")).join(found, "number")
    every = scanned.filter(F.size("sc_spans") == 0).withColumn("sc_found", none).drop("sc_spans").unionByName(with_spans.drop("sc_spans", "number"))
    return every.select(*[F.col("sc_row").getField(f"c{k}").alias(c) for k, c in enumerate(carry)], "sc_assign", "sc_access", "sc_hex", "sc_base", "sc_found")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Repository: the document; owner: its source. Base spans always stay; the other kinds stay where they look live."""
    found = judged(documents(spark, sf_dir), ["doc_id", "source"], "text", "doc_id", "source")
    stays = F.filter("sc_found", lambda s: (s["kind"] < BASE) | ~s["sc_wide"])
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(stays, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    live = F.size(F.filter("sc_found", lambda s: ~s["sc_wide"])).cast("long")
    return found.select(
        "doc_id", F.col("sc_assign").alias("n_assign"), F.col("sc_access").alias("n_access"), F.col("sc_hex").alias("n_hex"),
        F.col("sc_base").alias("base_sha256"), spans.alias("spans"), live.alias("n_live"), (F.size("sc_found") - live).cast("long").alias("n_copied"),
    )


#: Hashes of copied values that executors hold at once.
HELD = 1_000_000


def masked(docs: DataFrame, text_col: str = "text", repository: str = "doc_id", owner: str = "source", mark: str = "[secret]", held: int = HELD) -> DataFrame:
    """docs with every live-looking value replaced by `mark`; copied examples and all other rows stay as they are.

    Texts are looked at twice, so none is kept or shuffled: once for the hashes, and once with those of the copied
    values, which executors hold while they are `held` at most; of more, the spans of each text meet them by a join, and
    texts are joined with what is found. Null and empty texts, repeated rows, no rows: as for judged. Other columns stay,
    whatever their names."""
    scanned = _scan(docs, F.struct(*_owned(repository, owner)), text_col)
    wide = keep(ownership(scanned.select("sc_row.r", "sc_row.o", F.explode("sc_spans.hash").alias("hash"))).filter("sc_wide").select("hash"), "secrets-wide")
    schema = T.StructType([*docs.schema.fields])
    text_at = docs.columns.index(text_col)

    # runs of overlapping spans are replaced once, from the last to the first
    def replaced(text, spans):
        runs = []
        for a, b in spans:
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            text = text[:a] + mark + text[b:]
        return text

    def put(batch, texts):
        cols = list(batch.columns)[: len(schema.fields)]
        cols[text_at] = pa.array(texts, cols[text_at].type)
        return pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    if wide.count() <= held:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(wide.toArrow()["hash"].to_pylist()))

        def work(batches):
            for batch in slices(batches):
                copied = known.value
                yield put(batch, [t and replaced(t, [(a, b) for a, _, b, v in find(t) if _digest(v) not in copied]) for t in batch.column(text_at).to_pylist()])

        return docs.mapInArrow(work, schema)

    numbered = keep(docs.select(F.struct(F.monotonically_increasing_id().alias("number")).alias("sc_number"), whole_row(docs).alias("sc_row")), "secrets-rows")
    spans = _scan(numbered.withColumn("sc_text", F.col("sc_row").getField(text_col)), F.col("sc_number"), "sc_text").select("sc_row.number", F.explode("sc_spans").alias("s")).select("number", "s.*")
    live = spans.join(wide, "hash", "left_anti").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("sc_live"))  # of one text
    joined = numbered.withColumn("number", F.col("sc_number.number")).join(live, "number", "left")
    rows = joined.select(*[F.col("sc_row").getField(c).alias(c) for c in docs.columns], F.col("sc_live").alias("sc_live"))

    def mend(batches):
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            found = batch.column(batch.num_columns - 1).to_pylist()
            yield put(batch, [replaced(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in zip(texts, found, strict=True)])

    return rows.mapInArrow(mend, schema)
