"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their groups.

Equal sets become one node. A pass over a fixed part of the hashes counts in how many documents each shingle occurs;
a set that links shares so many of its shingles that most sets drop out there. For what is left, all shingles are
counted exactly, so the global order is rare first: a set's shingles that nothing else has come first and shuffle no
rows. Two sets that link share a shingle of their prefixes. Rows of one prefix shingle meet, pairs pass length and
positional filters, and what is left is verified once on whole sets, behind a suffix filter.

Counting. A task packs the shingles of a few hundred texts (a chunk) into sorted arrays, one for each range of hashes;
a shingle that several texts of a chunk have is one entry. A range's entries of all chunks meet, and the chunks get back
what occurs twice or more, with its count. So no task holds a shingle's documents, and shuffles grow with the text.

No group is turned into all its pairs. Rows of a group are chained in a few orders, verified pairs are united, and so
on with new orders while that links anything; only rows of a group that still lie in different components are paired
at last, salted, which loses no link between components. A shingle of very many rows is salted in the chains too, and
the heads of its parts meet.

Nodes are 64-bit hashes of sets: among n different sets two would fall together with probability n * n / 2**65. Keys
of shingles are shorter in the prefixes; shingles that fall together there make a pair more to verify, and lose none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, keep, thrifty, width
from .components import components
from .quality import _portions
from .shingles import shingle_sets

#: Part of the hashes that the first count takes: a set that links shares all but a fifth of its size of them.
PART = 0.4
#: Shingles of a range that one task counts, about.
RANGE = 1_000_000
#: Rows of a shingle that one task takes.
HOT = 5_000
#: Orders in which the rows of a group are chained at once at first, and how many times more in each next round.
ORDERS, MORE = 4, 12
#: Pairs a row of what is left, or pairs at all, up to which they are enumerated without more rounds of chains.
FEW, PAIRS = 4, 100_000
#: Texts that executors hold by hash, 8 bytes each, to pick out what is looked at again; more are joined.
HELD = 4_000_000
#: Rows of a table of keys that is broadcast.
KEYS = 1_000_000
#: Buckets of the suffix filter.
BUCKETS = 32
SEVERAL = 0xFFFF


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def apart(n):
    """Shingles of a set of n that a set which links with it may lack."""
    return n - -(-4 * n // 5)


def prefix_length(n):
    """A set of n shares one, at least, of its first so many shingles with each set that it links with."""
    return np.minimum(n, apart(n) + 1)


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """t, text: a hash of each text, and the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("t"), text.alias("text"))


def _node_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nd_id, t, n, node) of each row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("nd_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    kind = rows.schema["nd_id"].dataType.simpleString()

    def run(batches):
        for part, (texts,) in _portions(batches, (2,)):
            sets = shingle_sets([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64())], ["nd_id", "t", "n", "node"])

    return keep(rows.mapInArrow(run, f"nd_id {kind}, t bigint, n bigint, node bigint"), "near-nodes")


def _picked(docs: DataFrame, text_col: str, texts: DataFrame | None):
    """The rows (t, text) of docs, and how a task picks those of `texts` (t) out of them: a broadcast, or nothing where
    a join has done so already. texts None: all."""
    rows = _hashed(docs, text_col)
    if texts is None:
        return rows, None
    if texts.count() > HELD:
        return rows.join(texts.select("t"), "t", "left_semi"), None
    return rows, docs.sparkSession.sparkContext.broadcast(np.sort(texts.select("t").toArrow()["t"].to_numpy()))


def _sets_of(batches, held):
    """Portions as {node: (t, set)} of the texts with words that are held, each node once for a task as far as its
    memory of them reaches."""
    known: set[int] = set()

    def some():
        for batch in thrifty(batches):
            if held is not None:
                h, t = held.value, batch.column(0).to_numpy()
                found = h[np.minimum(np.searchsorted(h, t), len(h) - 1)] == t if len(h) else np.zeros(len(t), bool)
                batch = batch.filter(pa.array(found))
            yield batch

    for _, (ts, texts) in _portions(some(), (0, 1)):
        if len(known) > 2_000_000:
            known.clear()
        out = {}
        for t, s in zip(ts, shingle_sets([t or "" for t in texts]), strict=True):
            node = _node(s)
            if len(s) and node not in known:
                known.add(node)
                out[node] = (t, s)
        if out:
            yield out


# --- counting


def _runs(batches, at: int):
    """(key, rows) of rows in a row that agree in a column."""
    key, rows = None, []
    for batch in thrifty(batches):
        for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if rows and r[at] != key:
                yield key, rows
                rows = []
            key = r[at]
            rows.append(r)
    if rows:
        yield key, rows


PACKED = "p int, chunk bigint, a binary, b binary, c binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["p", "chunk", "a", "b", "c"])


def _chunk(chunk: int, of: dict, parts: int, space: int) -> list[tuple]:
    """PACKED rows of a chunk. One of p -1: a: nodes and hashes of texts, b: sizes and entries counted, c: keys and
    documents of entries that several documents have. One a range: a: low halves of hashes, b: the document of each, or
    SEVERAL, c: for those how many."""
    nodes = np.array(list(of), np.int64)
    sets = [s for _, s in of.values()]
    n = np.array([len(s) for s in sets], np.int32)
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
    high = x >> np.uint64(32)
    if space < 1 << 32:
        under = high < space
        x, doc, high = x[under], doc[under], high[under]
    used = np.bincount(doc, minlength=len(sets)).astype(np.int32)
    p = high * np.uint64(parts) // np.uint64(space)
    key = p << np.uint64(32) | x & np.uint64(0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    several = np.repeat(times > 1, times)
    out = [(-1, chunk, nodes.tobytes() + np.array([t for t, _ in of.values()], np.int64).tobytes(), n.tobytes() + used.tobytes(), key[several].tobytes() + doc[several].tobytes())]
    one, who = key[new], np.where(times > 1, SEVERAL, doc[new]).astype(np.uint16)
    at = np.searchsorted(one >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)).tolist()
    low = (one & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    many = np.minimum(times, 65535).astype(np.uint16)
    for k in range(parts):
        a, b = at[k], at[k + 1]
        if b > a:
            m = many[a:b]
            out.append((k, chunk, low[a:b].tobytes(), who[a:b].tobytes(), m[m > 1].tobytes()))
    return out


def _answers(p: int, rows: list[tuple]) -> list[tuple]:
    """PACKED rows of a range for its chunks: what occurs twice or more, and c: its count, up to 65535."""
    keys = [np.frombuffer(r[2], np.uint32) for r in rows]
    who = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])
    weight = np.ones(len(who))
    weight[who == SEVERAL] = np.concatenate([np.frombuffer(r[4], np.uint16) for r in rows])
    every = np.concatenate(keys)
    _, back = np.unique(every, return_inverse=True)
    count = np.minimum(np.bincount(back, weight)[back], 65535).astype(np.uint16)
    out, begin = [], 0
    for k, r in zip(keys, rows, strict=True):
        end = begin + len(k)
        m = count[begin:end] > 1
        if m.any():
            out.append((p, r[1], k[m].tobytes(), who[begin:end][m].tobytes(), count[begin:end][m].tobytes()))
        begin = end
    return out


def _shared(rows: list[tuple]):
    """Of a chunk's rows: nodes, texts, sizes, entries counted; document, key and count of each entry that occurs twice or more."""
    rows.sort(key=lambda r: r[0])
    _, _, a, b, c = rows[0]
    nodes, texts = np.frombuffer(a, np.int64).reshape(2, -1)
    n, used = np.frombuffer(b, np.int32).reshape(2, -1).astype(np.int64)
    pairs = len(c) // 10
    ck, cd = np.frombuffer(c[: 8 * pairs], np.uint64), np.frombuffer(c[8 * pairs :], np.uint16)
    none = np.zeros(0, np.uint64)
    key = np.concatenate([none, *[np.frombuffer(r[2], np.uint32) | np.uint64(r[0]) << np.uint64(32) for r in rows[1:]]])
    who = np.concatenate([none.astype(np.uint16), *[np.frombuffer(r[3], np.uint16) for r in rows[1:]]])
    count = np.concatenate([none.astype(np.uint16), *[np.frombuffer(r[4], np.uint16) for r in rows[1:]]])
    one = who != SEVERAL
    by = np.argsort(key[~one])
    sk, sc = key[~one][by], count[~one][by]
    counts = sc[np.searchsorted(sk, ck)] if pairs else np.zeros(0, np.uint16)
    return nodes, texts, n, used, np.concatenate([who[one], cd]).astype(np.int64), np.concatenate([key[one], ck]), np.concatenate([count[one], counts])


def _counted(docs: DataFrame, text_col: str, texts: DataFrame | None, total: int, part: float, finish, kind: str) -> DataFrame:
    """What finish makes of each chunk's _shared, as rows of kind; total: shingles that there are to count, about."""
    space = min(1 << 32, int(part * (1 << 32)))
    tasks = max(width(docs.sparkSession), int(total * part) // RANGE + 1)
    parts = 2 * tasks
    rows, held = _picked(docs, text_col, texts)

    def chunks(batches):
        task = TaskContext.get().partitionId() << 32
        for k, of in enumerate(_sets_of(batches, held)):
            yield _packed(_chunk(task + k, of, parts, space))

    def count(batches):
        for p, some in _runs(batches, 0):
            if p < 0:
                for a in range(0, len(some), 100):
                    yield _packed(some[a : a + 100])
            else:
                yield _packed(_answers(p, some))

    def close(batches):
        for _, some in _runs(batches, 1):
            yield finish(*_shared(some))

    # a chunk's own row goes where ranges go, spread by chunk
    spread = F.when(F.col("p") < 0, F.col("chunk")).otherwise(F.col("p"))
    met = rows.mapInArrow(chunks, PACKED).repartition(tasks, spread).sortWithinPartitions("p").mapInArrow(count, PACKED)
    return met.repartition(max(width(docs.sparkSession), tasks // 4), "chunk").sortWithinPartitions("chunk").mapInArrow(close, kind)


def _partners(nodes, texts, n, used, doc, key, count):
    """Sets of which enough shingles of the counted part occur elsewhere."""
    alone = used - np.bincount(doc, minlength=len(nodes))
    some = alone <= apart(n)
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(texts[some]), pa.array(n[some])], ["node", "t", "n"])


def _prefixes(nodes, texts, n, used, doc, key, count):
    """Rows of prefix shingles that occur elsewhere: rare first, after those that don't."""
    own = np.bincount(doc, minlength=len(nodes))
    order = np.lexsort((key, count, doc))
    doc, key, count = doc[order], key[order], count[order]
    rank = np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(own))[:-1], own)
    pos = (used - own)[doc] + rank
    first = pos < prefix_length(n)[doc]
    d = doc[first]
    return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(nodes[d]), pa.array(n[d].astype(np.int32)), pa.array(pos[first].astype(np.int32)), pa.array(1 + count[first].astype(np.int32) // HOT)], ["sh", "node", "n", "pos", "parts"])


# --- pairs


def _passes(n, pos, m, pos2):
    """Length and positional filters of a pair."""
    least = F.ceil((n + m) * 4 / 9)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (1 + F.least(n - pos, m - pos2) - 1 >= least)


def _neighbours(rows: DataFrame, keys: list[str], seed: int, labelled: bool = False) -> DataFrame:
    """Pairs (a, b) of each row with the one before it in its group's order; labelled: of different labels. Each next
    seed has MORE times as many orders: rows that few of their group link with need more neighbours to meet one."""
    orders = ORDERS * MORE**seed
    order = Window.partitionBy(*keys).orderBy("turn", "node")
    me = F.struct("node", "n", "pos", *["label"] * labelled)
    w = rows.withColumn("turn", F.xxhash64("node", F.pmod("sh", F.lit(orders)) + orders)).select("*", F.lag(me).over(order).alias("o"))
    w = w.filter("o is not null and o.node <> node").filter(_passes(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    if labelled:
        w = w.filter("o.label <> label")
    return w.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))


def _sets(docs: DataFrame, text_col: str, texts: DataFrame) -> DataFrame:
    """node, s: the sets of the nodes whose texts these are."""
    rows, held = _picked(docs, text_col, texts)

    def run(batches):
        for of in _sets_of(batches, held):
            ids = list(of)
            for a in range(0, len(ids), 1000):
                some = ids[a : a + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([of[i][1].tobytes() for i in some], pa.binary())], ["node", "s"])

    return rows.mapInArrow(run, "node bigint, s binary").groupBy("node").agg(F.first("s").alias("s"))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, for sorted distinct hashes."""
    least = -(-4 * (len(a) + len(b)) // 9)
    if min(len(a), len(b)) < least:
        return False
    # suffix filter: differences in the number of hashes of each range bound the differences of the sets
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    off = np.abs(np.bincount((a >> shift).astype(np.int64), minlength=BUCKETS) - np.bincount((b >> shift).astype(np.int64), minlength=BUCKETS)).sum()
    if off > len(a) + len(b) - 2 * least:
        return False
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])) >= least


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, partners: DataFrame) -> DataFrame:
    """pairs: a, b. Those that link, as u, v; each pair is compared once, on whole sets."""
    pairs = keep(pairs.distinct(), "near-pairs", large=True)
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = keep(partners.join(ids, "node", "left_semi").select("t"), "near-texts")
    sets = _sets(docs, text_col, texts)

    def run(batches):
        for x in batches:
            a, b, s, t = (x.column(k).to_pylist() for k in range(4))
            hit = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["u", "v"]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    links = keep(both.select("a", "b", "sa", "sb").mapInArrow(run, "u bigint, v bigint"), "near-links", large=True)
    discard(pairs)
    discard(texts)
    return links


def _left(rows: DataFrame, united: DataFrame) -> DataFrame:
    """Rows with their component as label, of the shingles that several components share, and `together`: the rows of
    their shingle, `same`: those of their label."""
    label = rows.join(united.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = keep(label.select("sh", "node", "n", "pos", "label"), "near-labels", large=True)
    by = label.groupBy("sh", "label").agg(F.count("*").alias("c"))
    mixed = by.groupBy("sh").agg(F.sum("c").alias("together"), F.sum(F.col("c").cast("double") * F.col("c")).alias("alike"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    left = keep(label.join(mixed, "sh"), "near-left", large=True)
    discard(label)
    return left


def _all_pairs(left: DataFrame) -> DataFrame:
    """Pairs of rows of one shingle in different components; a shingle of many rows is dealt out by parts."""
    parts = (1 + F.floor(F.col("together") / HOT)).cast("int")
    a = left.select("sh", "node", "n", "pos", "label", F.pmod("node", parts).alias("salt")).alias("a")
    b = left.select("sh", "node", "n", "pos", "label", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")).alias("b")
    smaller = F.struct("a.n", "a.node") < F.struct("b.n", "b.node")
    met = a.join(b, (F.col("a.sh") == F.col("b.sh")) & (F.col("a.salt") == F.col("b.salt")) & smaller & (F.col("a.label") != F.col("b.label")) & _passes(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def _components(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """u, v: every node with links but the smallest of its component, with that smallest one."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    found = _counted(docs, text_col, None, total, PART, _partners, "node bigint, t bigint, n bigint")
    partners = keep(found.groupBy("node").agg(F.min("t").alias("t"), F.first("n").alias("n")), "near-partners", large=True)
    total = partners.agg(F.sum("n")).first()[0] or 0
    rows = _counted(docs, text_col, partners.select("t"), total, 1.0, _prefixes, "sh bigint, node bigint, n int, pos int, parts int")
    rows = rows.withColumn("salt", F.pmod("node", F.col("parts")).cast("int")).repartition("sh", "salt")
    # copies of a text in several tasks are one node
    rows = rows.groupBy("sh", "salt", "node").agg(*[F.first(c).alias(c) for c in ("n", "pos", "parts")])
    alike = Window.partitionBy("sh", "salt")
    rows = rows.withColumns({"some": F.min("node").over(alike), "most": F.max("node").over(alike)})
    rows = keep(rows.filter("some <> most or parts > 1").drop("some", "most"), "near-rows", large=True)

    heads = rows.filter("parts > 1").groupBy("sh", "salt").agg(F.min(F.struct("node", "n", "pos")).alias("x")).select("sh", "x.*")
    links = _verified(_neighbours(rows, ["sh", "salt"], 0).unionByName(_neighbours(heads, ["sh"], 0)), docs, text_col, partners)
    united = components(links)
    seed, before = 1, None
    while True:
        left = _left(rows, united)
        size = left.select(F.count("*"), F.sum((F.col("together") - F.col("alike") / F.col("together")) / 2)).first()
        if not size[0]:
            return united
        # chains go on while they unite what is left; two that lie apart can't be told from two that don't but by comparing
        last = size[1] <= max(FEW * size[0], PAIRS) or before is not None and size[1] > before / 2
        before = size[1]
        if not last:
            # any shingle that two sets share may bring them together here, so all after their first one may be common
            by = left.withColumn("salt", F.pmod("node", (1 + F.floor(F.col("together") / HOT)).cast("int"))).withColumn("pos", F.min("pos").over(Window.partitionBy("node")))
            more = _verified(_neighbours(by, ["sh", "salt"], seed, labelled=True), docs, text_col, partners)
            seed += 1
            last = not more.limit(1).count()
        if last:
            more = _verified(_all_pairs(left), docs, text_col, partners)
            return components(united.unionByName(more)) if more.limit(1).count() else united
        discard(left)
        united = components(united.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, nd_shingles (size of its set) and nd_component: the smallest id that links
    reach, its own included.

    Null text and texts without words have no shingles, link with nothing and are a component each. Repeated rows have
    equal sets and one component. A null id is never the smallest unless all of a component are null. No rows: no rows.
    Columns other than id and text aren't looked at.
    """
    nodes = _node_table(docs, id_col, text_col)
    of_node = _components(docs, text_col, nodes)
    by_node = nodes.filter("n > 0").groupBy("node").agg(F.min("nd_id").alias("first"))
    by_node = by_node.join(of_node.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = by_node.groupBy("label").agg(F.min("first").alias("nd_component"))
    by_node = by_node.join(least, "label").select("node", "nd_component")
    with_words = nodes.filter("n > 0").join(by_node, "node").select("nd_id", "n", "nd_component")
    without = nodes.filter("n = 0").select("nd_id", "n", F.col("nd_id").alias("nd_component"))
    return with_words.unionByName(without).select(F.col("nd_id").alias(id_col), F.col("n").alias("nd_shingles"), "nd_component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group: the one of smallest id, null last. Of rows that agree in id and text
    any one stays. Texts aren't copied: a row is known by a hash of its id and text."""
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), name), F.lit("n")), F.lit("\1"), text).cast("binary"))
    row = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), key.alias("key"))
    groups = keep(near_duplicates(docs.select(row.alias("row"), text.alias("text")), "row", "text").filter("nd_shingles > 0").select("row", "nd_component"), "near-groups")
    gone = groups.filter("row <> nd_component").select("row.key").distinct()
    again = keep(groups.filter("row = nd_component").groupBy("row.key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "near-again")
    away = keep(gone.union(again), "near-gone")
    small = lambda df: F.broadcast(df) if df.count() <= KEYS else df
    key_name = _free(docs, "nd_key")
    keyed = docs.withColumn(key_name, key)
    stay = keyed.join(small(away.withColumnRenamed("key", key_name)), key_name, "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return stay
    of = F.struct(*[F.col(c) for c in docs.columns])
    twice = keyed.join(small(again.withColumnRenamed("key", key_name)), key_name, "left_semi").groupBy(key_name).agg(F.first(of).alias("x")).select("x.*")
    return stay.unionByName(twice)


def _free(docs: DataFrame, name: str) -> str:
    """name, or one like it that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.col("nd_shingles").alias("n_shingles"), F.col("nd_component").alias("component_id"))
