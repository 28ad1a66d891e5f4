"""Quality rules: base counts, and perplexity bands of an n-gram model counted over the corpus.

The model is a modified Kneser-Ney model of order 4 over characters, one for each language. Spark counts the 4-grams of
all texts; continuation counts, discounts, interpolated probabilities and back-off weights of every order follow from
them by aggregates and joins. It is stored as arrays of 64-bit hashes in sorted order, with log probabilities beside
them as whole micronats, so sums don't depend on their order. A document's log perplexity is compared with its
language's band: so many spreads (scaled median absolute deviations) below and above the median of all documents, and
for a short text a little more.

Characters hardly tell word salad from prose, so words are counted over the corpus too, one table for each language,
and a document's log perplexity a word has a band of its own. A document goes if it lies outside either.

While the arrays fit MODEL_ROWS, each executor gets them; a larger model stays a table, and each document's 4-grams
(or words) are joined with it. Both ways give the same sums.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import column, documents, keep, small, thrifty, unfolded, whole_row

ORDER = 4
#: Spreads below and above the median that a document may lie.
LOWER, UPPER = 7.0, 7.0
#: The same for words: lists of rare words without function words lie a few spreads low, salad of symbols many high.
WORD_LOWER, WORD_UPPER = 3.0, 5.0
#: A text of n characters (or words) may lie off by this over the square root of n more: means of short texts vary so.
SAMPLING = 2.0
#: Documents that a language needs for a model and band of its own, those with a band, and the least spread in nats.
ENOUGH, LEAST, LEAST_SPREAD = 50, 20, 0.02
#: Rows of a model (of characters, or of words) that executors hold at once, 20 to 24 bytes each (12 for a word).
MODEL_ROWS = 4_000_000
#: Characters that are counted together, and that are scored together: scoring takes some 150 bytes for each.
TOGETHER, SCORED = 1_000_000, 250_000
MICRO = 1_000_000
SYMBOLS = "#*$%&|<>"
FEW_WORDS, REPEATED = 20, 30
WINDOW = 8

BEGIN, END = 1, 2
MASK = {k: (1 << 16 * k) - 1 for k in range(1, ORDER)}


# --- characters and n-grams


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins (one more entry: the end)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(sizes))


def grams(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of each text as uint64, one for each character and one for its end; where each text's begin.

    A character is 16 bits: itself under 0xE000; those over it are folded into 0xE000 to 0xF8FF; 0 to 2 are 3.
    """
    n = len(bounds) - 1
    frame = ORDER  # three begins and an end for each text
    s = np.full(len(chars) + frame * n, BEGIN, np.uint64)
    c = np.where(chars < 0xE000, np.maximum(chars, 3), 0xE000 + chars % 0x1900)
    where = np.arange(len(chars)) + np.repeat(np.arange(n) * frame + ORDER - 1, np.diff(bounds))
    s[where] = c
    ends = bounds[1:] + frame * np.arange(1, n + 1) - 1
    s[ends] = END
    g = s.copy()
    for k in range(1, ORDER):
        g[k:] |= s[:-k] << np.uint64(16 * k)
    valid = np.ones(len(s), bool)
    first = bounds[:-1] + frame * np.arange(n)
    for k in range(ORDER - 1):
        valid[first + k] = False
    return g[valid], bounds + np.arange(n + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _portions(batches, columns, within: int | None = None, together: int = TOGETHER):
    """Lists of the columns' values, of some `together` characters each; the last column is the text, or a struct that
    has it in field `within`. Only the portion at hand is made Python strings."""
    for batch in thrifty(batches):
        arrays = [batch.column(k) for k in columns]
        if within is not None:
            arrays[-1] = arrays[-1].field(within)
        begin = total = 0
        sizes = pc.fill_null(pc.utf8_length(arrays[-1]), 0).to_pylist()
        for i, n in enumerate(sizes):
            total += n
            if total >= together or i + 1 == len(sizes):
                yield batch.slice(begin, i + 1 - begin), [x.slice(begin, i + 1 - begin).to_pylist() for x in arrays]
                begin, total = i + 1, 0


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, g, c: how often each 4-gram occurs in all texts of a language; null language: ''."""
    return _counted(docs, lang_col, text_col, lambda texts: grams(*points(texts))[0])


def count_words(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, g, c: how often each word, by its hash, occurs in all texts of a language; null language: ''."""
    return _counted(docs, lang_col, text_col, lambda texts: word_hashes(*points(texts))[1])


def _counted(docs: DataFrame, lang_col: str, text_col: str, hashes) -> DataFrame:
    """lang, g, c of what hashes gives for texts: counted in each task first."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def merge(parts):
        g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        new = np.append(True, g[1:] != g[:-1])
        return g[new], np.add.reduceat(c, np.nonzero(new)[0])

    def out(lang, g, c):
        for a in range(0, len(g), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[a : a + 200_000]), pa.string()), pa.array(g[a : a + 200_000].view(np.int64)), pa.array(c[a : a + 200_000])], ["lang", "g", "c"])

    def run(batches):
        held: dict[str, list] = {}
        for _, (langs, texts) in _portions(batches, (0, 1)):
            for lang in sorted(set(langs)):
                g = np.sort(hashes([t for x, t in zip(langs, texts, strict=True) if x == lang]))
                starts = np.nonzero(np.append(True, g[1:] != g[:-1]))[0]
                held.setdefault(lang, []).append((g[starts], np.diff(np.append(starts, len(g)))))
                if sum(len(x[0]) for x in held[lang]) > 4_000_000:
                    held[lang] = [merge(held[lang])]
                    if len(held[lang][0][0]) > 2_000_000:
                        yield from out(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield from out(lang, *merge(parts))

    return rows.mapInArrow(run, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))


# --- the model

#: Rows of a table that is broadcast: one for each language.
FEW = 10_000


def _few(df: DataFrame) -> DataFrame:
    """A kept table, marked to be broadcast if it has at most FEW rows; else it is joined as it is."""
    return small(keep(df, "quality-few"), FEW)


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 by counts of counts; a half, one and one and a half where those can't tell."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in range(1, 5)])
    y = F.expr("try_divide(n1, n1 + 2 * n2)")
    can = F.expr("n1 > 0 and n2 > 0 and n3 > 0")
    d = {"d1": 1 - 2 * y * F.expr("try_divide(n2, n1)"), "d2": 2 - 3 * y * F.expr("try_divide(n3, n2)"), "d3": 3 - 4 * y * F.expr("try_divide(n4, n3)")}
    return n.filter("n1 + n2 >= 0").select("lang", *[F.when(can & (e > 0.01) & (e < k), e).otherwise(0.5 * k).alias(a) for (a, e), k in zip(d.items(), (1, 2, 3), strict=True)])


def model(counts: DataFrame) -> DataFrame:
    """counts: lang, g, c of the highest order. Returns lang, k (order), g, lp, lb: micronats of the probability of the
    last character of g, and of the back-off weight of g as a context (null: g is no context, the weight is 1).

    k 0 has a row for each language, whose lp is that of an unknown character."""
    of = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # how many different characters stand before
        of[k] = keep(of[k + 1].groupBy("lang", F.expr(f"g & {MASK[k]}L").alias("g")).agg(F.count("*").alias("c")), f"quality-{k}")
    zero = of[1].groupBy("lang").agg(F.lit(0).cast("bigint").alias("g"), (1.0 / (F.count("*") + 1)).alias("p"))
    tables, lower = [zero.select("lang", F.lit(0).alias("k"), "g", F.col("p"), F.lit(None).cast("double").alias("b"))], zero
    for k in range(1, ORDER + 1):
        c = of[k].join(_few(_discounts(of[k])), "lang").withColumn("h", F.shiftrightunsigned("g", 16)).withColumn("d", _discount(F.col("c")))
        contexts = c.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("kept")).select("lang", "h", "total", (F.col("kept") / F.col("total")).alias("b"))
        suffix = F.expr(f"g & {MASK[k - 1]}L") if k > 1 else F.lit(0).cast("bigint")
        p = c.withColumn("s", suffix).join(contexts, ["lang", "h"]).join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("q")), ["lang", "s"])
        lower = keep(p.select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("b") * F.col("q")).alias("p")), f"quality-p{k}")
        tables.append(lower.select("lang", F.lit(k).alias("k"), "g", "p", F.lit(None).cast("double").alias("b")))
        tables.append(contexts.select("lang", F.lit(k - 1).alias("k"), F.col("h").alias("g"), F.lit(None).cast("double").alias("p"), "b"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    micro = lambda c: F.round(F.log(F.max(c)) * MICRO).cast("int")
    return every.groupBy("lang", "k", "g").agg(micro("p").alias("lp"), micro("b").alias("lb"))


class Arrays:
    """The model of one language as sorted hash arrays, one for each order."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """rows: order: (g as int64, lp, lb), in any order; missing lp: 1, missing lb: 0."""
        self.unknown = int(rows[0][1][0]) if 0 in rows and len(rows[0][1]) else -20 * MICRO
        self.base = int(rows[0][2][0]) if 0 in rows and len(rows[0][2]) else 0
        self.of = {}
        for k in range(1, ORDER + 1):
            g, lp, lb = rows.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)))
            h = mixed(g.astype(np.int64).view(np.uint64))
            order = np.argsort(h)
            h = h[order]
            bits = max(1, len(h).bit_length())
            index = np.searchsorted(h, np.arange((1 << bits) + 1, dtype=np.uint64)[:-1] << np.uint64(64 - bits)).astype(np.int32)
            self.of[k] = (h, np.asarray(lp, np.int32)[order], np.asarray(lb, np.int32)[order], index, np.uint64(64 - bits))

    def find(self, k: int, g: np.ndarray) -> np.ndarray:
        """The place of each n-gram, -1 for those that aren't there."""
        h, _, _, index, shift = self.of[k]
        out = np.full(len(g), -1, np.int64)
        if not len(h):
            return out
        x = mixed(g)
        at = index[x >> shift].astype(np.int64)
        left = np.arange(len(g))
        while len(left):
            here = np.minimum(at, len(h) - 1)
            same = (h[here] == x) & (at < len(h))
            out[left[same]] = here[same]
            more = ~same & (at < len(h)) & (h[here] < x)
            left, x, at = left[more], x[more], at[more] + 1
        return out

    def log(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Micronats of the last character of each n-gram of order k."""
        if not k:
            return np.full(len(g), self.unknown, np.int64)
        at = self.find(k, g)
        lp = self.of[k][1]
        out = lp[at].astype(np.int64) if len(lp) else np.zeros(len(g), np.int64)
        missing = np.nonzero((at < 0) | (out > 0))[0] if len(lp) else np.arange(len(g))
        if len(missing):
            rest = g[missing]
            if k > 1:
                context = self.find(k - 1, rest >> np.uint64(16))
                lb = self.of[k - 1][2]
                back = np.where(context >= 0, lb[context], 0) if len(lb) else 0
            else:
                back = self.base
            out[missing] = back + self.log(rest & np.uint64(MASK[k - 1]) if k > 1 else rest, k - 1)
        return out


def _arrays(rows: DataFrame) -> dict[str, Arrays]:
    t = rows.toArrow()
    if not t.num_rows:
        return {}
    lang = t["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    codes, k, g = lang.indices.to_numpy(), t["k"].to_numpy(), t["g"].to_numpy()
    lp, lb = t["lp"].fill_null(1).to_numpy(), t["lb"].fill_null(0).to_numpy()
    return {n: Arrays({o: (g[m], lp[m], lb[m]) for o in range(ORDER + 1) for m in [(codes == i) & (k == o)]}) for i, n in enumerate(names)}


# --- words


def word_model(counts: DataFrame) -> DataFrame:
    """lang, g, lp: micronats of the probability of each word that occurs twice or more, by its hash; g null: of those
    that occur once, which have no rows of their own."""
    total = _few(counts.groupBy("lang").agg(F.sum("c").alias("total")))
    lp = F.round(F.log(F.col("c") / F.col("total")) * MICRO).cast("int").alias("lp")
    once = total.select("lang", F.lit(None).cast("bigint").alias("g"), F.lit(1).alias("c"), "total")
    return counts.filter("c > 1").join(total, "lang").select("lang", "g", "c", "total").unionByName(once).select("lang", "g", lp)


class Words:
    """The words of one language in the order of their hashes."""

    def __init__(self, g: np.ndarray, lp: np.ndarray, once: int):
        h = g.astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.h, self.lp, self.once = h[order], lp[order].astype(np.int32), once

    def log(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.once, np.int64)
        if len(self.h) and len(h):
            u, back = np.unique(h, return_inverse=True)  # in order, so that the search stays in the cache
            at = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
            out = np.where(self.h[at] == u, self.lp[at], self.once).astype(np.int64)[back]
        return out


def _words(rows: DataFrame) -> dict[str, Words]:
    t = rows.toArrow()
    if not t.num_rows:
        return {}
    lang = t["lang"].combine_chunks().dictionary_encode()
    names, codes, lp = lang.dictionary.to_pylist(), lang.indices.to_numpy(), t["lp"].to_numpy()
    none, g = t["g"].is_null().to_numpy(), t["g"].fill_null(0).to_numpy()
    return {n: Words(g[m & ~none], lp[m & ~none], int(lp[m & none][0])) for i, n in enumerate(names) for m in [codes == i]}


# --- base counts

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, m in enumerate((_M, _INVERSE)):
            p = np.full(2 * n, m, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def _prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run follows: (s[b] - s[a]) * inverse power of a."""
    return np.append(np.uint64(0), np.cumsum(values * _power(len(values) + 1)[0][: len(values)]))


def _is_space(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


def word_hashes(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters begin a word, and a hash of each word, in order."""
    word = ~_is_space(chars)
    begins = word.copy()
    if len(chars):
        begins[1:] &= ~word[:-1]
        inner = bounds[1:-1][bounds[1:-1] < len(chars)]
        begins[inner] = word[inner]
    start = np.nonzero(begins)[0]
    sums = _prefix_hashes(np.where(word, mixed(chars.astype(np.uint64) + np.uint64(1)), np.uint64(0)))
    # spaces add nothing, so a word's hash may run to the next word
    return begins, mixed((sums[np.append(start[1:], len(chars))] - sums[start]) * _power(len(chars) + 1)[1][start]) if len(start) else np.zeros(0, np.uint64)


def base_counts(texts: list[str], chars: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    per = lambda flags: np.diff(np.append(0, np.cumsum(flags))[bounds])
    begins, hashes = word_hashes(chars, bounds)
    word = ~_is_space(chars)
    low = np.zeros(128, bool)
    low[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": per(begins), "word_chars": per(word), "n_symbols": per(low[np.minimum(chars, 127)] & (chars < 128))}
    strip = " \t\n\v\f\r"
    lines = [[x for x in t.split("\n") if x.strip(strip)] for t in texts]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)

    first = np.append(0, np.cumsum(out["n_words"]))
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    n = len(hashes) - WINDOW + 1
    repeat = np.zeros(len(hashes), bool)
    if n > 0:
        sums = _prefix_hashes(hashes)
        windows = (sums[WINDOW : WINDOW + n] - sums[:n]) * _power(n)[1][:n] + mixed(doc[:n].astype(np.uint64) + np.uint64(7))
        whole = np.nonzero(doc[:n] == doc[WINDOW - 1 :])[0]
        windows = windows[whole]
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edges, whole[twice], 1)
        np.add.at(edges, whole[twice] + WINDOW, -1)
        repeat = np.cumsum(edges[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.append(0, np.cumsum(repeat))[first])
    return {k: v.astype(np.int64) for k, v in out.items()}


# --- documents

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(rows: DataFrame, grams_shared, words_shared, within: int | None = None) -> DataFrame:
    """rows: qu_row (whatever it is), qu_lang, qu_text; within: qu_row and qu_lang alone, the text is that field of qu_row.
    Gives qu_row, qu_lang, COUNTS, qu_chars (log probabilities summed), qu_log and qu_word_log; the logs are 0 for what
    isn't shared."""
    names = ["qu_row", "qu_lang", *[f"qu_{c}" for c in COUNTS], "qu_chars", "qu_log", "qu_word_log"]

    def run(batches):
        held = grams_shared.value if grams_shared is not None else None
        words = words_shared.value if words_shared is not None else None
        nothing = Arrays({})
        for part, (langs, texts) in _portions(batches, (1, 2) if within is None else (1, 0), within, SCORED):
            texts = [t or "" for t in texts]
            chars, bounds = points(texts)
            counts = base_counts(texts, chars, bounds)
            logs, word_logs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for lang in sorted(set(langs)) if held is not None or words is not None else ():
                which = np.array([i for i, x in enumerate(langs) if x == lang])
                c, b = points([texts[i] for i in which])
                if held is not None:
                    g, at = grams(c, b)
                    logs[which] = np.diff(np.append(0, np.cumsum(held.get(lang, nothing).log(g)))[at])
                if words is not None and lang in words:
                    at = np.append(0, np.cumsum(counts["n_words"][which]))
                    word_logs[which] = np.diff(np.append(0, np.cumsum(words[lang].log(word_hashes(c, b)[1])))[at])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(counts[c]) for c in COUNTS], pa.array(np.diff(bounds) + 1), pa.array(logs), pa.array(word_logs)], names)

    kind = rows.schema["qu_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"qu_row {kind}, qu_lang string, {', '.join(f'qu_{c} bigint' for c in COUNTS)}, qu_chars bigint, qu_log bigint, qu_word_log bigint")


def _joined_logs(rows: DataFrame, m: DataFrame) -> DataFrame:
    """qu_row, qu_log by joins: each row's 4-grams, counted, meet the model's table order by order."""

    def run(batches):
        for _, (ids, langs, texts) in _portions(batches, (0, 1, 2)):
            for i, lang, t in zip(ids, langs, texts, strict=True):
                g, c = np.unique(grams(*points([t or ""]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i)), pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["qu_row", "lang", "g", "n"])

    todo = rows.select("qu_number", "qu_lang", "qu_text").mapInArrow(run, "qu_row bigint, lang string, g bigint, n bigint").withColumn("lg", F.lit(0).cast("bigint"))
    done = None
    for k in range(ORDER, -1, -1):
        at = m.filter(F.col("k") == k)
        p = todo.join(at.filter("lp is not null").select("lang", "g", "lp"), ["lang", "g"], "left")
        hit = p.filter("lp is not null") if k else p
        found = hit.select("qu_row", (F.col("n") * (F.col("lg") + F.coalesce("lp", F.lit(-20 * MICRO)))).alias("lg"))
        done = found if done is None else done.unionByName(found)
        if k:
            back = m.filter(F.col("k") == k - 1).filter("lb is not null").select("lang", F.col("g").alias("h"), "lb")
            rest = p.filter("lp is null").withColumn("h", F.shiftrightunsigned("g", 16))
            suffix = F.expr(f"g & {MASK[k - 1]}L") if k > 1 else F.lit(0).cast("bigint")
            todo = rest.join(back, ["lang", "h"], "left").select("qu_row", "lang", suffix.alias("g"), "n", (F.col("lg") + F.coalesce("lb", F.lit(0))).alias("lg"))
    return done.groupBy("qu_row").agg(F.sum("lg").alias("qu_log"))


def _joined_word_logs(rows: DataFrame, words: DataFrame) -> DataFrame:
    """qu_row, qu_word_log by a join of each row's words, counted, with the table; rows without words are left out."""

    def run(batches):
        for _, (ids, langs, texts) in _portions(batches, (0, 1, 2)):
            for i, lang, t in zip(ids, langs, texts, strict=True):
                g, c = np.unique(word_hashes(*points([t or ""]))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int64)), pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["qu_row", "lang", "g", "n"])

    each = rows.select("qu_number", "qu_lang", "qu_text").mapInArrow(run, "qu_row bigint, lang string, g bigint, n bigint")
    once = _few(words.filter("g is null").select("lang", F.col("lp").alias("once")))
    p = each.join(words.filter("g is not null"), ["lang", "g"], "left").join(once, "lang", "left")
    return p.groupBy("qu_row").agg(F.sum(F.col("n") * F.coalesce("lp", "once")).alias("qu_word_log"))


def _languages(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """qu_lang, qu_text and qu_row (all columns) of each row; languages of few documents are one together."""
    lang = F.coalesce(F.concat(F.lit("l"), column(lang_col).cast("string")), F.lit(""))
    many = docs.groupBy(lang.alias("qu_many")).agg(F.count("*").alias("n")).filter(F.col("n") >= ENOUGH).select("qu_many")
    rows = docs.select(whole_row(docs).alias("qu_row"), lang.alias("qu_own"), column(text_col).cast("string").alias("qu_text"))
    known = rows.join(_few(many), F.col("qu_own") == F.col("qu_many"), "left")
    return known.select("qu_row", F.coalesce("qu_many", F.lit("few")).alias("qu_lang"), "qu_text")


def _scored(docs: DataFrame, row, text_col: str, lang_col: str, model_rows: int, within: int | None = None) -> DataFrame:
    """qu_row (what row makes of a row of docs), qu_lang, base counts, qu_base_failed, qu_milli and qu_word_milli
    (thousandths of nats a character and a word) of each row. Not kept, so that texts in qu_row need no room.
    within: the field of qu_row that is the text, so that a text goes to Python once."""
    spark = docs.sparkSession
    rows = _languages(docs, lang_col, text_col)
    texts = rows.select("qu_lang", "qu_text")
    m = keep(model(keep(count_grams(texts, "qu_lang", "qu_text"), "quality-4")), "quality-model")
    words = keep(word_model(keep(count_words(texts, "qu_lang", "qu_text"), "quality-words")), "quality-word-model")
    rows = rows.select(row("qu_row").alias("qu_row"), "qu_lang", "qu_text")
    held = spark.sparkContext.broadcast(_arrays(m)) if m.count() <= model_rows else None
    held_words = spark.sparkContext.broadcast(_words(words)) if words.count() <= model_rows else None
    if held is not None and held_words is not None:
        measured = _measured(rows if within is None else rows.drop("qu_text"), held, held_words, within)
    else:
        numbered = keep(rows.withColumn("qu_number", F.monotonically_increasing_id()), "quality-rows")
        measured = _measured(numbered.select(F.struct("qu_number", "qu_row").alias("qu_row"), "qu_lang", "qu_text"), held, held_words)
        measured = measured.withColumn("qu_number", F.col("qu_row.qu_number")).withColumn("qu_row", F.col("qu_row.qu_row"))
        if held is None:
            measured = measured.drop("qu_log").join(_joined_logs(numbered, m).withColumnRenamed("qu_row", "qu_number"), "qu_number")
        if held_words is None:
            measured = measured.drop("qu_word_log").join(_joined_word_logs(numbered, words).withColumnRenamed("qu_row", "qu_number"), "qu_number", "left")
        measured = measured.drop("qu_number")
    few, many = F.col("qu_n_words") < FEW_WORDS, 100 * F.col("qu_n_repeat_words") > REPEATED * F.col("qu_n_words")
    # whole thousandths: the values of a language stay few, so its exact percentiles are a small aggregate
    milli = lambda log, n: F.round(F.try_divide(-F.col(log), F.col(n)) / (MICRO / 1000)).cast("int")
    return measured.withColumns({"qu_base_failed": few | many, "qu_milli": milli("qu_log", "qu_chars"), "qu_word_milli": milli("qu_word_log", "qu_n_words")})


def _bands(measured: DataFrame, lower: float, upper: float, word_lower: float, word_upper: float) -> DataFrame:
    """qu_lang, qu_low, qu_high, qu_word_low and qu_word_high of the languages that have a band."""
    counted = measured.filter(~F.col("qu_base_failed"))
    both = ("qu_", "qu_word_")
    middle = counted.groupBy("qu_lang").agg(*[F.percentile(f"{p}milli", F.lit(0.5)).alias(f"{p}middle") for p in both], F.count("*").alias("qu_docs"))
    spread = counted.join(_few(middle), "qu_lang").groupBy("qu_lang").agg(
        *[F.percentile(F.abs(F.col(f"{p}milli") - F.col(f"{p}middle")), F.lit(0.5)).alias(f"{p}mad") for p in both], *[F.first(c).alias(c) for c in ("qu_middle", "qu_word_middle", "qu_docs")]
    )
    s = {p: F.greatest(F.col(f"{p}mad") * 1.4826 / 1000, F.lit(LEAST_SPREAD)) for p in both}
    widths = {"qu_": (lower, upper), "qu_word_": (word_lower, word_upper)}
    edges = [(F.col(f"{p}middle") / 1000 + sign * w * s[p]).alias(f"{p}{edge}") for p in both for edge, sign, w in zip(("low", "high"), (-1, 1), widths[p], strict=True)]
    return _few(spread.filter(F.col("qu_docs") >= LEAST).select("qu_lang", *edges))


def _verdicts(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """measured and qu_log_perplexity, qu_word_perplexity, the bands and qu_kept."""
    perplexity = {p: F.col(f"{p}milli") / 1000 for p in ("qu_", "qu_word_")}
    slack = {"qu_": SAMPLING / F.sqrt("qu_chars"), "qu_word_": F.coalesce(F.try_divide(F.lit(SAMPLING), F.sqrt("qu_n_words")), F.lit(0.0))}
    inside = F.lit(True)
    for p in perplexity:
        inside = inside & F.coalesce(perplexity[p].between(F.col(f"{p}low") - slack[p], F.col(f"{p}high") + slack[p]), F.lit(True))
    return measured.join(bands, "qu_lang", "left").withColumns({"qu_log_perplexity": perplexity["qu_"], "qu_word_perplexity": perplexity["qu_word_"], "qu_kept": ~F.col("qu_base_failed") & inside})


GIVEN = (*[f"qu_{c}" for c in COUNTS], "qu_base_failed", "qu_log_perplexity", "qu_low", "qu_high", "qu_word_perplexity", "qu_word_low", "qu_word_high", "qu_kept")


def judged(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", model_rows: int = MODEL_ROWS, lower: float = LOWER, upper: float = UPPER, word_lower: float = WORD_LOWER, word_upper: float = WORD_UPPER) -> DataFrame:
    """A row for each row of docs: the columns of carry, qu_n_words and the other base counts, qu_base_failed,
    qu_log_perplexity (nats a character), qu_low and qu_high (its language's band), qu_word_perplexity (nats a word, null
    without words), qu_word_low and qu_word_high, and qu_kept.

    Null text: as the empty one, no words. Null language: a language of its own. Languages with under ENOUGH documents
    are judged as one together; if under LEAST of theirs pass the base rules, there is no band, and those stay. Repeated
    rows count and are judged alike. No rows: no rows. Other columns go; a column of carry that has a name of GIVEN goes too.
    """
    carry = [c for c in carry if c not in GIVEN]
    row = lambda r: F.struct(F.lit(0).alias("none"), *[F.col(r).getField(c).alias(f"c{k}") for k, c in enumerate(carry)])
    measured = keep(_scored(docs, row, text_col, lang_col, model_rows), "quality")
    found = _verdicts(measured, _bands(measured, lower, upper, word_lower, word_upper))
    return found.select(*[F.col("qu_row").getField(f"c{k}").alias(c) for k, c in enumerate(carry)], *GIVEN)


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns, whatever their names. Scored twice, for the bands and
    for the rows, so that no text is kept or shuffled. Nulls, repeated rows and no rows: as for judged."""
    there = [k for k, f in enumerate(docs.schema.fields) if f.name == text_col and f.dataType == StringType()]
    measured = _scored(docs, F.col, text_col, lang_col, MODEL_ROWS, there[0] if there else None)
    numbers = keep(measured.select("qu_lang", "qu_base_failed", "qu_milli", "qu_word_milli"), "quality-numbers")
    found = _verdicts(measured, _bands(numbers, LOWER, UPPER, WORD_LOWER, WORD_UPPER)).filter("qu_kept")
    return unfolded(found, "qu_row", docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", *[F.col(f"qu_{c}").alias(c) for c in COUNTS], F.col("qu_base_failed").alias("base_failed"), F.col("qu_kept").alias("kept"), F.round(F.exp("qu_log_perplexity"), 6).alias("perplexity"))
