"""Toxicity by a weighted grammar of finite-state transducers.

Five weighted transducers are composed, each reading what the one before writes. The insult transducer reads words: it
matches prefix patterns letter by letter, learned from labelled rows, and stated words, and phrases whose head is an
insult only with what stands before it. The threat transducer matches verbs of violence, which weigh more after an
announcement ("will", "gonna") and hardly anything without a person in reach. Reported speech, negation and target change
the weights of the arcs that they span: what follows a verb of saying, or a negation closely, and what stands with a
person. Every clause with an insult or a threat runs through the composition; a document's features are sums over the
arcs and weights of its matched clauses, and a logistic model of them, fitted on the labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

# Words of the grammar in English, German, French and Spanish.
INSULTS = """asshole bastard bitch cretin clown coward creep disgusting dumb fool freak garbage idiot imbecile jerk liar loser moron
pathetic pig rat scum stupid trash vermin worthless abschaum arschloch dummkopf idioten schwachkopf trottel connard crétin imbécile
salaud basura cabrón escoria estúpido idiota imbécil""".split()
THREATS = "kill hurt destroy murder beat hang shoot stab strangle töten umbringen tuer frapper matar destruir".split()
TARGETS = "you your yours you're he him she her they them their these those people du dich dir ihr euch sie tu toi vous ils elles tú te ustedes ellos ellas".split()
NEGATIONS = "not never no nor neither hardly isn't aren't don't won't nicht nie kein keine ne pas jamais nunca jamás tampoco".split()
ANNOUNCEMENTS = "will gonna going shall must should i'll we'll werde wirst soll vais va voy vamos".split()
#: Insults of two words: the second is one only after the first.
PHRASES = ("piece shit", "son bitch", "waste space", "dumb ass", "brain dead", "low life", "sac merde", "hijo puta")
#: Words that may stand between the two.
BETWEEN = "of a an the de del la".split()
REPORTS = "said says say told tells called calls wrote writes quoted quotes claimed claims reported reports sagte nannte schrieb dit dirent écrit dijo llamó escribió".split()

#: Labelled rows that a model is fitted on, at most: those of smallest hash.
TRAIN_ROWS = 20_000
#: A learned pattern is a prefix of so many letters.
PREFIX = range(4, 13)
#: Evidence that a pattern needs: likelihood ratio statistic, and log odds of toxic against other documents.
EVIDENCE, ODDS = 26.0, 1.5
#: Weight of an insult without evidence from labels, and of a threat; what an announcement does to a threat.
PRIOR, THREAT, ANNOUNCED = 3.0, 2.0, 1.5
#: What marks do to an arc's weight.
MARKS = {"-": 0.6, "~": 0.6, "+": 1.2}
#: Words that a negation reaches, and an announcement.
REACH, AHEAD = 3, 4
MEMO = 400_000

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


class Transducer:
    """Deterministic and weighted: step(state, (symbol, weight)) -> (state, (symbol, weight)); the start state is 0.
    Symbols are a tag and marks; weights multiply along a path."""

    def __init__(self, step):
        self.step = step

    def compose(self, other: Transducer) -> Transducer:
        """Runs other on what self puts out."""

        def step(state, arc):
            a, b = state or (0, 0)
            a, out = self.step(a, arc)
            b, out = other.step(b, out)
            return (a, b), out

        return Transducer(step)

    def run(self, arcs):
        state, out = 0, []
        for x in arcs:
            state, o = self.step(state, x)
            out.append(o)
        return out


def insults(lexicon: Lexicon) -> Transducer:
    """Reads words. I: an insult; N, R, T, A: words of the grammar; H: a verb of violence; o: others. The state is the
    first word of a phrase that is open."""

    def step(state, arc):
        word, weight = arc
        if state and (state, word) in lexicon.phrases:
            return 0, ("I", weight * PRIOR)
        tag, v = lexicon.word(word) or ("o", 1.0)
        state = word if word in lexicon.heads else state if state and word in lexicon.between else 0
        return state, (tag, weight * v)

    return Transducer(step)


def _threatened(state, arc):
    """A threat after an announcement weighs more; the state is how far that still reaches."""
    s, w = arc
    if s == "A":
        return AHEAD, ("o", w)
    return max(0, state - 1), (s, w * ANNOUNCED) if state and s == "H" else arc


def _reported(state, arc):
    s, w = arc
    if s == "R":
        return 1, arc
    return state, (s + "~", w * MARKS["~"]) if state and s[0] in "IH" else arc


def _negated(state, arc):
    s, w = arc
    if s == "N":
        return REACH, arc
    return max(0, state - 1), (s + "-", w * MARKS["-"]) if state and s[0] in "IH" else arc


def _targeted(state, arc):
    """An insult or threat after a target is marked; a target after one becomes an arc of its own, L."""
    s, w = arc
    if s == "T":
        return (3, ("L", w)) if state == 2 else (state or 1, arc)
    if s[0] in "IH":
        return (3, (s + "+", w * MARKS["+"])) if state in (1, 3) else (2, arc)
    return state, arc


#: What is the same for every lexicon.
RULES = Transducer(_threatened).compose(Transducer(_reported)).compose(Transducer(_negated)).compose(Transducer(_targeted))


class Lexicon:
    """What single words are. learned: {prefix: weight}, as a trie that is walked letter by letter."""

    def __init__(self, learned: dict[str, float]):
        self.trie: dict = {}
        for p, v in learned.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = v
        every = (("N", 1.0, NEGATIONS), ("R", 1.0, REPORTS), ("A", 1.0, ANNOUNCEMENTS), ("T", 1.0, TARGETS), ("H", THREAT, THREATS), ("I", PRIOR, INSULTS))
        self.fixed = {w: (t, v) for t, v, words in every for w in words}
        self.phrases = {tuple(p.split()) for p in PHRASES}
        self.heads, self.between = {a for a, _ in self.phrases}, frozenset(BETWEEN)
        self.seconds = {b for _, b in self.phrases}
        self.grammar = insults(self).compose(RULES)
        self.memo: dict[str, tuple | None] = {}

    def word(self, word: str):
        """(tag, weight); None for other words. Of learned prefixes the longest."""
        node, found = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return ("I", found) if found is not None else self.fixed.get(word)

    def starts(self, words: list[str]) -> list:
        """Whether a clause with each word has to run through the grammar: an insult, a threat or the end of a phrase."""
        memo = self.memo
        try:
            return [memo[w] for w in words]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = (self.word(w) or "o")[0] in "IH" or w in self.seconds
            return [memo[w] for w in words]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Weight and number of matched arcs, number of matched clauses, arcs of each mark, and links to targets."""
    words = TOKEN.findall((text or "").lower())
    weight = arcs = clauses = links = 0.0
    marks = dict.fromkeys(MARKS, 0.0)
    last = -1
    for at, hit in enumerate(lexicon.starts(words)):
        if at <= last or not hit:
            continue
        begin = at
        while begin and words[begin - 1] not in ENDS:
            begin -= 1
        last = at
        while last + 1 < len(words) and words[last + 1] not in ENDS:
            last += 1
        matched = False
        for s, w in lexicon.grammar.run([(w, 1.0) for w in words[begin : last + 1]]):
            if s == "L":
                links += 1
            elif s[0] in "IH":
                matched = True
                for m in s[1:]:
                    marks[m] += 1
                weight += w
                arcs += 1
        clauses += matched
    return [math.log1p(weight), min(weight, 20.0) / 4, float(arcs >= 1), float(arcs >= 2), float(arcs >= 3), min(clauses, 6) / 3, min(links, 3), *(min(v, 3) for v in marks.values())]


def _ratio(a: float, n: float, b: float, m: float) -> float:
    """Likelihood ratio statistic of a of n against b of m."""
    p = (a + b) / (n + m)
    x = lambda k, n, q: k * math.log(q) if k else 0.0  # noqa: E731, ARG005
    part = lambda k, n, q: x(k, n, q) + x(n - k, n, 1 - q)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p)) if 0 < p < 1 else 0.0


def _evidence(a: str, b: str, toxic: int, other: int):
    """_ratio as an expression; 0 where the share in toxic documents is the smaller one, or the odds are too small."""
    x, y, n, m = F.col(a).cast("double"), F.col(b).cast("double"), float(toxic), float(other)
    p = (x + y) / (n + m)
    log = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(F.lit(0.0))
    part = lambda k, total, q: log(k, q) + log(total - k, 1 - q)
    g = 2 * (part(x, F.lit(n), x / n) + part(y, F.lit(m), y / m) - part(x, F.lit(n), p) - part(y, F.lit(m), p))
    odds = F.log((x + 0.5) / (n + 1)) - F.log((y + 0.5) / (m + 1))
    return F.when((x / n >= y / m) & (odds >= ODDS * 0.999), F.coalesce(g, F.lit(0.0))).otherwise(F.lit(0.0))


def patterns(rows: list[tuple[str, int, int, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Prefixes with evidence. rows: (prefix, toxic documents that have it, others, toxic that have it twice, others)."""
    found = []
    for p, a, b, a2, b2 in rows:
        best = max((_ratio(x, toxic, y, other), x, y) for x, y in ((a, b), (a2, b2)) if x / toxic >= y / other) if a / toxic >= b / other or a2 / toxic >= b2 / other else (0, 0, 0)
        odds = math.log((best[1] + 0.5) / (toxic + 1)) - math.log((best[2] + 0.5) / (other + 1))
        if best[0] >= EVIDENCE and odds >= ODDS:
            found.append((best[0], len(p), p, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))))
    out: dict[str, float] = {}
    for _, _, p, w in sorted(found, reverse=True):
        if not any(p.startswith(q) or q.startswith(p) for q in out):
            out[p] = min(6.0, max(0.5, w))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Without labels: weights of the features that the stated words alone give.
UNTRAINED = [-3.0, 1.0, 1.0, 1.5, 1.0, 0.5, *[0.0] * 5]


def fit(labelled: DataFrame, limit: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """labelled: tx_id, text, toxic (0 or 1). Patterns and weights from at most `limit` rows."""
    rows = labelled.filter("text is not null and toxic is not null").select("tx_id", "text", F.col("toxic").cast("int").alias("toxic"))
    bounded = rows.orderBy(F.crc32(F.concat(F.lit("fit:"), F.col("tx_id").cast("string")).cast("binary")), "tx_id").select("text", "toxic").limit(limit)
    bounded = keep_bounded(bounded)
    sums = {r.toxic: r.n for r in bounded.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sums.get(1, 0), sums.get(0, 0)
    if not toxic or not other:
        return {}, UNTRAINED

    def prefixes(batches):
        for batch in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text, y in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                of: Counter = Counter()
                for w, n in Counter(TOKEN.findall(text.lower())).items():
                    for k in PREFIX:
                        if len(w) < k:
                            break
                        of[w[:k]] += n
                for p, n in of.items():
                    c = counts[p]
                    c[0 if y == 1 else 1] += 1
                    if n > 1:
                        c[2 if y == 1 else 3] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]], ["p", "a", "b", "a2", "b2"])

    found = bounded.mapInArrow(prefixes, "p string, a bigint, b bigint, a2 bigint, b2 bigint").groupBy("p").agg(*[F.sum(c).alias(c) for c in ("a", "b", "a2", "b2")])
    # only prefixes with the evidence come to the driver: each stands in documents of at most `limit` labelled ones
    found = found.withColumn("g", F.greatest(_evidence("a", "b", toxic, other), _evidence("a2", "b2", toxic, other))).filter(F.col("g") >= EVIDENCE * 0.999).drop("g")
    learned = patterns([tuple(r) for r in found.collect()], toxic, other)

    def vectors(batches):
        lexicon = Lexicon(learned)
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "y"])

    data = bounded.mapInArrow(vectors, "x array<double>, y int").toPandas()  # at most `limit` rows of a few numbers
    order = np.lexsort(np.array(data["x"].tolist()).T)  # the same sums in whatever order the rows came
    return learned, _logistic(np.array(data["x"].tolist())[order], (data["y"].to_numpy() == 1)[order].astype(float)).tolist()


def keep_bounded(df: DataFrame) -> DataFrame:
    from .common import keep, width

    return keep(df.repartition(max(4, min(64, width(df.sparkSession)))), "toxicity")


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id and tx_score in 0 to 1. Null and empty texts have no arcs and get the base rate.
    Repeated rows and null ids: like others. No rows: no rows. Only the text is an input of the score."""
    learned, weights = model
    rows = docs.select(F.col(id_col).alias("tx_id"), F.col(text_col).cast("string").alias("tx_text"))
    kind = rows.schema["tx_id"].dataType.simpleString()

    def run(batches):
        lexicon, w = Lexicon(learned), np.array(weights)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, len(w) - 1)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], [id_col, "tx_score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, tx_score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Several labels of one document are one: toxic if any of them says so."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", "toxic")
    first = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.crc32(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(TRAIN_ROWS)
    labelled = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select(F.col("doc_id").alias("tx_id"), "text", "toxic")
    return score(docs, fit(labelled)).select("doc_id", held_out().alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.5).cast("int").alias("predicted"))
