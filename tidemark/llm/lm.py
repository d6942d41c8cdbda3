"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Words are mapped to SYMBOLS symbols: the most frequent words of the training
documents and, for all others, buckets by their first letters. A token's probability
is that of its symbol after the two before it, times, for a bucket, the word's share
of the bucket, which holds its training counts and one slot for unseen words. The
symbol model is log-bilinear: the score of w after (a, b) is w . (C1 a + C2 b) plus a
bias, so the scores of all symbols after all contexts are products of small matrices,
and their normalisers are computed once for every pair of context symbols. The token
log-probabilities are therefore exactly normalised, and scoring a token is four
look-ups.

Every training document is learned from: each partition trains on its own tokens
from the same start, and parameters are averaged with each row's token count as its
weight. Counts are exact. The most frequent words are broadcast, a bounded head; the
tail is joined by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TOKENS, checkpointed, held_out, map_arrow, share, split, table

#: Symbols, of which so many are buckets; width of the model; words whose counts are broadcast.
SYMBOLS, BUCKETS, WIDTH, HEAD = 1024, 256, 16, 200_000
#: Tokens of a step, noise symbols that they share, and the rate of Adagrad.
STEP, NOISE, RATE = 2048, 32, 0.1
#: Tokens that one model learns from, about, before the models are averaged.
LOT = 1 << 21
#: The end of a text as a word; no word can hold a line end.
END = "\n"
#: Words longer than this many bytes are known by their digest.
LONG = 64


def _name(word: bytes) -> str:
    if len(word) <= LONG:
        return word.decode("utf-8", "surrogatepass")
    import hashlib

    return "\n" + hashlib.sha256(word).hexdigest()


def bucket(word: str) -> int:
    """The bucket of a word that is no symbol of its own: its first three letters, hashed."""
    import zlib

    return zlib.crc32(word[:3].encode("utf-8", "surrogatepass")) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts, with one end a text; counts are combined in the worker and before the shuffle."""

    def run(batches) -> Iterator[dict]:
        held: Counter = Counter()
        for (texts,) in batches:
            for t in texts:
                held.update(split(t, TOKENS))
            held[b"\n"] += len(texts)
            if len(held) > 1 << 20:
                yield {"word": [_name(w) for w in held], "n": list(held.values())}
                held = Counter()
        yield {"word": [END if w == b"\n" else _name(w) for w in held], "n": list(held.values())}

    return map_arrow(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _most_frequent(counts: DataFrame) -> list:
    """HEAD words of LONG bytes at most, the most frequent first: all above the least count, by a histogram, that leaves no more."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384)  # 1024 and more go on from step 1024
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > HEAD:
            break
        least = r["step"]
    rows = counts.where(step >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r.c, r.word))


class Head:
    """The broadcast part: frequent words with counts and symbols, bucket totals, and the corpus's size."""

    def __init__(self, words: list[tuple[str, int]], n: int, v: int):
        self.n, self.v = n, v
        self.count = {w: c for w, c in words}
        own = [w for w, _ in words[: SYMBOLS - BUCKETS - 1] if w != END]
        self.symbol = {w: BUCKETS + 1 + i for i, w in enumerate(own)} | {END: BUCKETS}

    def key(self, word: bytes) -> tuple[str, int, int]:
        """Name, symbol and count of a word; the count is -1 in the tail."""
        name = END if word == b"\n" else _name(word)
        s = self.symbol.get(name)
        return name, bucket(name) if s is None else s, self.count.get(name, -1)


class _Keys(dict):
    def __init__(self, head: Head):
        self.head, self.names, self.symbols, self.counts = head, [], [], []

    def __missing__(self, word: bytes) -> int:
        name, s, c = self.head.key(word)
        self.names.append(name)
        self.symbols.append(s)
        self.counts.append(c)
        at = self[word] = len(self.names) - 1
        return at


def _numbered(texts, keys: _Keys) -> Iterator[np.ndarray]:
    for t in texts:
        words = split(t, TOKENS)
        words.append(b"\n")
        yield np.fromiter(map(keys.__getitem__, words), np.int32, len(words))


def _contexts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each of a text, which ends precede."""
    padded = np.concatenate([np.full(2, BUCKETS), s])
    return padded[1:-1], padded[:-2]


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by number: the numbers and the sums."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort at this width
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class LogBilinear:
    """Parameters c1, c2 (contexts), r (targets) and b, with Adagrad's sums."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.c1, self.c2, self.r = (rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for _ in range(3))
        self.log_p = np.log(unigram).astype(np.float32)
        self.b = self.log_p.copy()
        self.noise = np.cumsum(unigram)
        self.sums = {k: np.full(n, 1e-2, np.float32) for k in ("c1", "c2", "r", "b")}

    def _step(self, name: str, at: np.ndarray, grad: np.ndarray) -> None:
        value, sums = getattr(self, name), self.sums[name]
        sums[at] += (grad**2).mean(axis=1) if grad.ndim > 1 else grad**2
        scale = RATE / np.sqrt(sums[at])
        value[at] -= grad * (scale[:, None] if grad.ndim > 1 else scale)

    def learn(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> None:
        """One step of NCE: tell the words of a step from NOISE words that all of it shares."""
        h = self.c1[a] + self.c2[b]
        drawn = np.searchsorted(self.noise, rng.random(NOISE)).clip(0, len(self.b) - 1)
        ln_k = np.float32(np.log(NOISE))
        rw, rn = self.r[w], self.r[drawn]
        s_pos = np.einsum("ij,ij->i", h, rw) + self.b[w] - self.log_p[w] - ln_k
        s_neg = h @ rn.T + (self.b[drawn] - self.log_p[drawn] - ln_k)
        g_pos = (-1 / (1 + np.exp(np.clip(s_pos, -30, 30)))).astype(np.float32)
        g_neg = (1 / (1 + np.exp(-np.clip(s_neg, -30, 30)))).astype(np.float32)
        grad_h = g_pos[:, None] * rw + g_neg @ rn
        at_w = np.concatenate([w, drawn])
        rows = np.concatenate([g_pos[:, None] * h, g_neg.T @ h])
        flat = np.concatenate([g_pos, g_neg.sum(0)])
        at, total = _add(self.r, at_w, np.concatenate([rows, flat[:, None]], axis=1))
        self._step("r", at, total[:, :-1])
        self._step("b", at, total[:, -1])
        for name, ctx in (("c1", a), ("c2", b)):
            self._step(name, *_add(self.c1, ctx, grad_h))


class Scorer:
    """Normalised symbol log-probabilities (base 10) after every pair of symbols."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray, r: np.ndarray, b: np.ndarray):
        self.one, self.two = c1 @ r.T + b, c2 @ r.T
        n = len(b)
        self.norm = np.empty((n, n), np.float32)
        e2 = np.exp(self.two)
        for lo in range(0, n, 128):  # sums over w of exp(one[a, w] + two[b, w]), as a product of matrices
            self.norm[lo : lo + 128] = np.log(np.exp(self.one[lo : lo + 128]) @ e2.T)

    def score(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.one[a, w] + self.two[b, w] - self.norm[a, b]) / np.log(10)


def _train(docs: DataFrame, head, unigram: np.ndarray, tokens: int) -> Scorer:
    """Trains on lots of about LOT tokens and averages; what comes back has SYMBOLS rows, whatever the corpus.

    Lots and their order go by hashes of the rows, so that the model is a function of
    the documents, however they are partitioned.
    """
    start = share(docs.sparkSession, unigram)
    lots = max(1, -(-tokens // LOT))
    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    dealt = docs.select(F.pmod(key, F.lit(lots)).alias("lot"), F.xxhash64(F.lit(1), key, "text").alias("place"), "text")
    dealt = dealt.repartition(lots, "lot").sortWithinPartitions("lot", "place", "text")

    def run(batches) -> Iterator[dict]:
        keys, lot, model = _Keys(head()), None, None
        w_, a_, b_, waiting, seen = [], [], [], 0, None

        def learn(least: int) -> None:
            nonlocal w_, a_, b_, waiting
            if waiting < least or not waiting:
                return
            w, a, b = np.concatenate(w_), np.concatenate(a_), np.concatenate(b_)
            order = rng.permutation(len(w))  # a step mixes texts, so that no language fills it
            steps = max(1, len(w) // STEP)
            for part in np.array_split(order, steps):
                model.learn(w[part], a[part], b[part], rng)
            for s, x in zip(seen, (w, a, b), strict=True):
                s += np.bincount(x, minlength=SYMBOLS)
            w_, a_, b_, waiting = [], [], [], 0

        def ended() -> Iterator[dict]:
            learn(0)
            for kind, (values, count) in enumerate(((model.r, seen[0]), (model.c1, seen[1]), (model.c2, seen[2]))):
                at = np.flatnonzero(count)
                rows = np.concatenate([values, model.b[:, None]], axis=1) if kind == 0 else np.pad(values, ((0, 0), (0, 1)))
                yield {"lot": [lot] * len(at), "kind": [kind] * len(at), "at": at, "n": count[at], "v": list((rows[at] * count[at][:, None]).astype(np.float64))}

        for numbers, texts in batches:
            if len(keys) > 1 << 19:
                keys = _Keys(head())
            flat = list(_numbered(texts, keys))
            symbols = np.array(keys.symbols, np.int64)
            for number, ids in zip(numbers, flat, strict=True):
                if number != lot:
                    if model is not None:
                        yield from ended()
                    lot, model, rng = number, LogBilinear(start()), np.random.default_rng(5)
                    seen = [np.zeros(SYMBOLS) for _ in range(3)]
                w = symbols[ids]
                a, b = _contexts(w)
                w_.append(w)
                a_.append(a)
                b_.append(b)
                waiting += len(w)
                learn(STEP * 64)
        if model is not None:
            yield from ended()

    parts = map_arrow(dealt.select("lot", "text"), run, "lot long, kind int, at int, n double, v array<double>")
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(WIDTH + 1)]
    rows = parts.groupBy("kind", "at").agg(F.sum("n").alias("n"), *sums).collect()
    first = LogBilinear(unigram)
    for x in rows:
        mean = np.array(x[3:], np.float64) / x["n"]
        target = (first.r, first.c1, first.c2)[x["kind"]]
        target[x["at"]] = mean[:-1]
        if x["kind"] == 0:
            first.b[x["at"]] = mean[-1]
    return Scorer(first.c1, first.c2, first.r, first.b)


def score_texts(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """(doc_id, text) scored by a model learned from learn_from(text), one row for each document row.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score (the smoothed unigram
    log10 probability) and score (the model's). Null and empty texts are one end.
    Rows are told apart by position, so repeated documents stay repeated. With nothing
    to learn from every token has probability one under the base.
    """
    spark = docs.sparkSession
    counts = word_counts(learn_from)
    # The counts are used three times; written once, they also outlive their executors.
    counts = checkpointed(counts)
    top = _most_frequent(counts)
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = Head([(r.word, r.c) for r in top], size.n, size.v)

    def by_bucket(batches) -> Iterator[dict]:
        h, sums = symbols(), np.zeros(SYMBOLS)
        for words, cs in batches:
            for w, c in zip(words, cs, strict=True):
                s = h.get(w)
                if s is None:
                    sums[bucket(w)] += c + 0.5
                else:
                    sums[s] += c + 0.5
        yield {"at": range(SYMBOLS), "m": sums}

    symbols = share(spark, head.symbol)
    mass = np.zeros(SYMBOLS)
    for r in map_arrow(counts, by_bucket, "at int, m double").groupBy("at").agg(F.sum("m").alias("m")).collect():
        mass[r["at"]] = r.m
    mass[:BUCKETS] += 0.5  # a slot for unseen words
    mass[mass == 0] = 0.5
    held = share(spark, head)
    scorer = _train(learn_from, held, mass / mass.sum(), size.n)
    total = size.n + 0.5 * (size.v + 1)
    model = share(spark, (scorer, np.log10(mass), np.log10(total)))

    def run(batches) -> Iterator[dict]:
        (scorer, log_mass, log_total), keys = model(), _Keys(held())
        for rows, ids, texts in batches:
            if len(keys) > 1 << 19:
                keys = _Keys(held())
            out = {k: [] for k in ("row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", "times")}
            flat = list(_numbered(texts, keys))
            symbols, counts = np.array(keys.symbols, np.int64), np.array(keys.counts, np.int64)
            for row, key, at in zip(rows, ids, flat, strict=True):
                s, c = symbols[at], counts[at]
                a, b = _contexts(s)
                is_head = c >= 0
                log_c = np.log10(c[is_head] + 0.5)
                share = log_c[s[is_head] < BUCKETS].sum() - log_mass[s[s < BUCKETS]].sum()
                tail, times = np.unique(at[~is_head], return_counts=True)
                out["row"].append(row)
                out["doc_id"].append(key)
                out["n_tokens"].append(len(at))
                out["n_known"].append(int(is_head.sum()))
                out["base"].append(float(log_c.sum() - len(at) * log_total))
                out["score"].append(float(scorer.score(s, a, b).sum(dtype=np.float64) + share))
                out["tail"].append([keys.names[i] for i in tail.tolist()])
                out["times"].append(times.tolist())
            yield out

    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, tail array<string>, times array<int>"
    # Row numbers must not change if a task runs again for one side of the join only.
    scored = checkpointed(map_arrow(named, run, schema))
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    known = tail.join(counts, "word", "left")
    value = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    added = known.groupBy("row").agg(F.sum(value).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"))
    more = F.coalesce(F.col("_more"), F.lit(0.0))
    return scored.drop("tail", "times").join(added, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("_known"), F.lit(0))).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores every document; learns from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, docs.where(~held_out("doc_id", 5, 1)))
    return scored.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
