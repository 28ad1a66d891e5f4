"""Suffix-array dedup: remove every byte that a string of `length` bytes covers which also starts elsewhere.

Candidates. Every string of `length` bytes has an anchor: the string of _k(length) bytes of smallest hash inside it, the leftmost of
equal ones. Equal strings have equal anchors at equal places, so only strings that share an anchor are compared. The
distances that a string can have from its anchor are cut into parts; all strings of a part contain the anchor and some
bytes on both sides of it, the core. Only cores that occur twice are looked at: an occurrence is a document of its own
here, the bytes beside the core that its strings cover, aligned at the core.

Construction. A block of such documents is built column by column: each round inserts one symbol of every document,
right to left, into the sorted order of their suffixes, and updates the common prefixes of neighbours from those of
the round before (a stable sort by the new symbol, and range minima). Only the newest suffix of every document is
held, as older ones start at other distances from the anchor and can't equal it. A string is repeated if its suffix
has all of its symbols in common with a neighbour.

Hot cores. One with over LIMIT contexts is split by longer strings: the distances of its part are halved, and each half
is keyed by its own, longer core, and so on; single distances are keyed by the string itself and merely counted. So no
task holds an unbounded group, and nothing is dropped. Cores are compared by 64-bit hashes of their bytes.

Equal texts are one text here (64-bit hash); a text that occurs twice is repeated as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, keep, thrifty, width
from .quality import _power, _prefix_hashes, mixed

LENGTH = 400
#: Bytes of an anchor, at most, and the part of `length` that it is at most. Short ones would repeat by chance.
ANCHOR, PART = 96, 4
#: Times that the distances of an anchor are halved at first.
LEVEL = 2
#: Contexts of a core that one block takes.
LIMIT = 8192
#: Anchors, or texts, that executors hold at once, 8 bytes each, to pick out what repeats; more are joined.
HELD = 4_000_000
#: Bytes that are worked on together.
TOGETHER = 1_000_000
PLACE = np.uint64((1 << 28) - 1)

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _k(length: int) -> int:
    return max(1, min(ANCHOR, length // PART))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    padded = np.append(x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


def _anchored(data: bytes, length: int):
    """As anchors, and sums from which the hash of any run of bytes follows."""
    n = len(data)
    if n < length:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(1, np.uint64)
    k = _k(length)
    sums = _prefix_hashes(_BYTES[np.frombuffer(data, np.uint8)])
    h = mixed((sums[k:] - sums[:-k]) * _power(n + 1)[1][: n - k + 1])
    at = (sliding_least(h & ~PLACE | np.arange(len(h), dtype=np.uint64), length - k + 1) & PLACE).astype(np.int64)
    begin = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
    end = np.append(begin[1:], len(at)) - 1
    p = at[begin]
    return h[p].view(np.int64), p, p - end, p - begin, sums


def anchors(data: bytes, length: int = LENGTH):
    """key, place, lo, hi of each run of strings with one anchor: those that start lo to hi bytes before it."""
    return _anchored(data, length)[:4]


def _halves(length: int, level: int) -> list[tuple[int, int]]:
    """The distances from 0 on that an anchor can have, halved so many times."""
    parts = [(0, length - _k(length))]
    for _ in range(level):
        parts = [x for a, b in parts for x in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if a < b else [(a, b)])]
    return parts


def cores(data: bytes, length: int, held=None):
    """key, place, part, lo, hi: of each run of strings with one anchor (of those held) those whose distances lo to hi
    lie in one part of the distances; key: a hash of the part and of the bytes, the core, that all strings of the part contain."""
    key, p, lo, hi, sums = _anchored(data, length)
    if held is not None:
        of = _among(key, held)
        p, lo, hi = p[of], lo[of], hi[of]
    a, b = np.array(_halves(length, LEVEL), np.int64).T
    near, far = np.maximum(lo[:, None], a), np.minimum(hi[:, None], b)
    r, j = np.nonzero(near <= far)
    begin, end = p[r] - a[j], p[r] - b[j] + length
    h = mixed((sums[end] - sums[begin]) * _power(len(data) + 1)[1][begin] + mixed(j.astype(np.uint64) + np.uint64(1)))
    return h.view(np.int64), p[r], j, near[r, j], far[r, j]


def _texts(batches, text_at: int = 0):
    """Portions of distinct texts as bytes: each text once for a task, as far as its memory of them reaches."""
    seen: set[int] = set()
    for batch in thrifty(batches):
        out, total = [], 0
        for x in batch.column(text_at).to_pylist():
            x = x or b""
            t = _hash(x)
            if t in seen:
                continue
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(t)
            out.append((t, x))
            total += len(x)
            if total > TOGETHER:
                yield out
                out, total = [], 0
        if out:
            yield out


def _held(df: DataFrame, column: str):
    """A broadcast of the sorted distinct values, if there are at most HELD; else nothing."""
    if df.count() > HELD:
        return None
    return df.sparkSession.sparkContext.broadcast(np.sort(df.select(column).toArrow()[column].to_numpy()))


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


#: A context: the key of a core, distances lo to hi of its strings from the anchor, and the bytes beside the core that
#: they cover: those before it and those behind, in a row; sub is a hash of all that.
CONTEXT = "key bigint, lo int, hi int, x binary, sub bigint"
#: A context in a text, and where its anchor stands there.
OCCURRENCE = f"{CONTEXT}, t bigint, ps array<bigint>, n bigint"


def _sub(key: int, lo: int, hi: int, x: bytes) -> int:
    return _hash(b"%d %d %d " % (key, lo, hi) + x)


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """key, c: how often each of the keys that keys_of finds in a text occurs."""

    def run(batches):
        for texts in _texts(batches):
            keys, c = np.unique(np.concatenate([keys_of(x) for _, x in texts]), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c)], ["key", "c"])

    return rows.mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _batch_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    names = ["key", "lo", "hi", "x", "sub", "t", "ps", "n"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)


def _contexts_of(t: int, data: bytes, length: int, anchors_held, cores_held) -> list[tuple]:
    """OCCURRENCE of each different context of a text; a periodic text has few, though many anchors."""
    parts = _halves(length, LEVEL)
    key, *rest = cores(data, length, anchors_held)
    of = _among(key, cores_held)
    at: dict[tuple, list[int]] = {}
    for p, j, near, far in zip(*(x[of].tolist() for x in rest), strict=True):
        a, b = parts[j]
        core = _hash(b"%d " % j + data[p - a : p - b + length])
        at.setdefault((core, near, far, data[p - far : p - a] + data[p - b + length : p - near + length]), []).append(p)
    return [(*c, _sub(*c), t, ps, len(ps)) for c, ps in at.items()]


def _occurrences(rows: DataFrame, length: int, anchors_held, cores_held) -> DataFrame:
    """OCCURRENCE of the cores that are held."""

    def run(batches):
        first = anchors_held.value if anchors_held is not None else None
        for texts in _texts(batches):
            found = []
            for t, data in texts:
                found += _contexts_of(t, data, length, first, cores_held.value)
                if len(found) > 5000:
                    yield _batch_of(found)
                    found = []
            if found:
                yield _batch_of(found)

    return rows.mapInArrow(run, OCCURRENCE)


def _cut_out(rows: DataFrame, twice: DataFrame, length: int, anchors_held) -> DataFrame:
    """OCCURRENCE when there are too many cores to hold: the texts with some meet those by hash."""

    def name(batches):
        first = anchors_held.value if anchors_held is not None else None
        for texts in _texts(batches):
            keys = [np.unique(cores(x, length, first)[0]) for _, x in texts]
            t = np.repeat(np.array([t for t, _ in texts], np.int64), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(t)], ["key", "t"])

    def data(batches):
        for texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts], pa.int64()), pa.array([x for _, x in texts], pa.binary())], ["t", "data"])

    def cut(batches):
        for batch in thrifty(batches):
            for t, x, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield _batch_of(_contexts_of(t, x, length, None, np.sort(np.array(keys, np.int64))))

    of_text = rows.mapInArrow(name, "key bigint, t bigint").distinct().join(twice.select("key"), "key", "left_semi").groupBy("t").agg(F.collect_list("key").alias("keys"))
    whole = rows.mapInArrow(data, "t bigint, data binary").groupBy("t").agg(F.first("data").alias("data"))
    return whole.join(of_text, "t").select("t", "data", "keys").mapInArrow(cut, OCCURRENCE)


# --- construction


def repeated(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: list[bytes], length) -> np.ndarray:
    """For documents of a block, sorted by group: flags (document, distance) of strings that another document of the
    group has at the same distance. data: the bytes from hi before a point to length - lo after it; length: of a string,
    a number, or one for each document, the same in a group."""
    length = np.broadcast_to(np.asarray(length), len(group))
    n, far, near = len(group), int(hi.max()), int(lo.min())
    wide = far - near + int(length.max())
    symbols = np.full((n, wide), 256, np.uint16)
    for r, (x, a) in enumerate(zip(data, (far - hi).tolist(), strict=True)):
        symbols[r, a : a + len(x)] = np.frombuffer(x, np.uint8)
    symbols = np.ascontiguousarray(symbols.T)
    small = np.unique(group, return_inverse=True)[1]
    kind = np.uint16 if n <= 1 << 16 else np.int64
    group = small.astype(kind)
    most = np.int32(1 << 20)
    order = np.arange(n)  # documents by the suffixes so far
    common = np.where(np.append(True, group[1:] != group[:-1]), np.int32(0), most)  # with the one before
    flags = np.zeros((n, far - near + 1), bool)
    if not wide - (far - near):  # strings without bytes of their own
        flags[:, :] = True
    for c in range(wide - 1, -1, -1) if wide > far - near else ():
        s, g = symbols[c][order], group[order]
        by = np.argsort(s, kind="stable")
        by = by[np.argsort(g[by], kind="stable")]
        s, g = s[by], g[by]
        same = np.nonzero((s[1:] == s[:-1]) & (g[1:] == g[:-1]))[0] + 1
        fresh = np.zeros(n, np.int32)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = by[same - 1] + 1, by[same] + 1
            fresh[same] = np.minimum(np.minimum.reduceat(np.append(common, most), ends)[0::2] + 1, most)
        order, common = order[by], fresh
        if c <= far - near:  # strings at distance far - c
            hit = common >= length[order]
            hit[:-1] |= hit[1:].copy()
            flags[order[hit], far - near - c] = True
    distance = near + np.arange(far - near + 1)
    return flags & (distance >= lo[:, None]) & (distance <= hi[:, None])


def _built(contexts: DataFrame, length: int, level: int) -> DataFrame:
    """sub, a, b: runs of distances of repeated strings, from contexts in blocks of whole groups."""
    parts = np.array(_halves(length, level), np.int64)

    def block(held):
        key, lo, hi = (np.array([r[k] for r in held], np.int64) for k in range(3))
        first, last = parts[np.searchsorted(parts[:, 0], lo, side="right") - 1].T
        # without the core, which all strings of a part contain, a string is as long as the part has steps
        flags = repeated(np.cumsum(np.append(0, key[1:] != key[:-1])), lo - first, hi - first, [r[3] for r in held], last - first)
        edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1] - 1
        near, sub = int((lo - first).min()) + first[row], np.array([r[4] for r in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sub[row]), pa.array((near + begin).astype(np.int32)), pa.array((near + end).astype(np.int32))], ["sub", "a", "b"])

    def run(batches):
        held: list = []
        for batch in thrifty(batches):
            for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if len(held) >= LIMIT and r[0] != held[-1][0]:
                    yield block(held)
                    held = []
                held.append(r)
        if held:
            yield block(held)

    dealt = contexts.repartition(max(12, 2 * width(contexts.sparkSession)), "key").sortWithinPartitions("key", "sub")
    return dealt.select("key", "lo", "hi", "x", "sub").mapInArrow(run, "sub bigint, a int, b int")


def _split(contexts: DataFrame, length: int, level: int) -> DataFrame:
    """CONTEXT of this level and `of`, the context of the level before that it is a part of: its core is that one's and
    the bytes beside it that all strings of the part contain too."""
    above, parts = _halves(length, level - 1), _halves(length, level)

    def run(batches):
        for batch in thrifty(batches):
            out = []
            for key, lo, hi, x, sub in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                a, b = above[bisect_right(above, (lo, length)) - 1]
                cut = hi - a  # the bytes before the core
                left, right = x[:cut], x[cut:]
                for c, d in parts[bisect_left(parts, (a, 0)) : bisect_right(parts, (b, length))]:
                    near, far = max(c, lo), min(d, hi)
                    if near <= far:
                        core = _hash(b"%d %d %d " % (key, level, c) + left[hi - c :] + b"|" + right[: b - d])
                        part = left[hi - far : hi - c] + right[b - d : b - near]
                        out.append((core, near, far, part, _sub(core, near, far, part), sub))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["key", "lo", "hi", "x", "sub", "of"])
            for k in range(0, whole.num_rows, 5000):
                yield whole.slice(k, 5000)

    return contexts.select("key", "lo", "hi", "x", "sub").mapInArrow(run, f"{CONTEXT}, of bigint")


def _resolved(rows: DataFrame, length: int, level: int) -> DataFrame:
    """rows: CONTEXT of this level and n. Returns sub, a, b: runs of distances at which a context's strings are repeated.

    A context that occurs twice is repeated at all of its distances, and one of it is enough to compare others with.
    """
    first = {c: F.first(c).alias(c) for c in ("key", "lo", "hi", "x")}
    contexts = keep(rows.groupBy("sub").agg(*first.values(), F.sum("n").alias("n")), "contexts", large=True)
    found = keep(contexts.filter("n > 1").select("sub", F.col("lo").alias("a"), F.col("hi").alias("b")), "distances")
    sizes = keep(contexts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "contexts-sizes")
    ready = contexts.join(sizes.filter(F.col("c") <= LIMIT).select("key"), "key", "left_semi")
    found = found.unionByName(keep(_built(ready, length, level), "distances", large=True))
    hot = sizes.filter(F.col("c") > LIMIT).select("key")
    if hot.limit(1).count():
        parts = keep(_split(contexts.join(hot, "key", "left_semi"), length, level + 1), "contexts-parts", large=True)
        deeper = _resolved(parts.withColumn("n", F.lit(1).cast("bigint")), length, level + 1)
        found = found.unionByName(keep(parts.select("sub", "of").join(deeper, "sub").select(F.col("of").alias("sub"), "a", "b"), "distances"))
        discard(parts)
    discard(contexts)
    return found


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows: one binary column of texts. Returns t (hash of a text), ps, a, b: strings of `length` bytes that start a to
    b bytes before the places ps also start elsewhere, in another text or the same one."""
    first = _held(keep(_counted(rows, lambda x: anchors(x, length)[0]).filter("c > 1"), "anchors-twice"), "key")
    twice = keep(_counted(rows, lambda x: cores(x, length, first.value if first is not None else None)[0]).filter("c > 1"), "cores-twice", large=True)
    held = _held(twice, "key")
    found = _occurrences(rows, length, first, held) if held is not None else _cut_out(rows, twice, length, first)
    found = keep(found, "occurrences", large=True)
    distances = _resolved(found.select("key", "lo", "hi", "x", "sub", "n"), length, LEVEL)
    return found.select("sub", "t", "ps").join(distances, "sub").select("t", "ps", "a", "b")


# --- documents


def merged(found, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of `length` cover which start a to b bytes before places; found: (places, a, b)."""
    runs = ((p - b, p - a) for places, a, b in found for p in places)
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


DIGEST = "n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>"


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256 and spans (maximal removed runs).

    Null text: as the empty one. Texts under `length` bytes, and so empty ones, lose nothing. Repeated rows repeat each
    other as a whole, if they are long enough. Null ids: like others. No rows: no rows. Other columns aren't looked at.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("x"))
    rows = docs.select(F.col(id_col).alias("ss_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("x"))
    kind = rows.schema["ss_id"].dataType.simpleString()

    def name(batches):
        for batch in thrifty(batches):
            data = batch.column(1).to_pylist()
            cols = [pa.array([_hash(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["ss_id", "t", "n", "sha"])

    named = keep(rows.mapInArrow(name, f"ss_id {kind}, t bigint, n bigint, sha string"), "texts")
    copied = named.filter(F.col("n") >= length).groupBy("t").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c > 1")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = keep(copied.select("t", F.col("n").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))).alias("spans")), "texts-copied")
    starts = repeated_starts(texts, length).join(whole.select("t"), "t", "left_anti")
    runs = starts.groupBy("t").agg(F.collect_list(F.struct("ps", "a", "b")).alias("runs"))  # of one text
    runs = keep(runs, "texts-runs", large=True)
    held = _held(runs.select("t"), "t")

    def pick(batches):
        for some in _texts(batches):
            if held is not None:
                of = _among(np.array([t for t, _ in some], np.int64), held.value)
                some = [x for x, y in zip(some, of, strict=True) if y]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], ["t", "x"])

    def cut(batches):
        for batch in thrifty(batches):
            cols: list[list] = [[] for _ in range(4)]
            for x, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merged([(y["ps"], y["a"], y["b"]) for y in r], length)
                kept, at = hashlib.sha256(), 0
                for a, b in [*spans, (len(x), len(x))]:
                    kept.update(x[at:a])
                    at = b
                for c, v in zip(cols, (sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"a": a, "b": b} for a, b in spans]), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["t", "n_removed", "n_spans", "kept_sha256", "spans"])

    met = texts.mapInArrow(pick, "t bigint, x binary").join(runs, "t").select("t", "x", "runs")
    part = met.mapInArrow(cut, f"t bigint, {DIGEST}").groupBy("t").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "spans")])
    all_of = whole.unionByName(part)
    zero = F.lit(0).cast("bigint")
    return named.join(all_of, "t", "left").select(
        F.col("ss_id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"),
    )


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).drop("spans")
