"""N-gram Jaccard join by parity sketches, the classes its links make, and their number.

Two documents link when their sets of five-word shingles have a Jaccard similarity of
0.75 or more, so their symmetric difference is at most a seventh of their sizes' sum.
A document's sketch deals its shingles over parts by hash and XORs the hashes inside
each part; a shingle that only one of two documents has changes one part at most, so
the number of parts that differ is a lower bound of the symmetric difference. By the
pigeonhole principle two documents that link agree in all but D parts. Parts are
numbered per size band (powers of four; a document that can link into the next band is
sketched there too), and since at least (parts - D) agree, it is enough to join the
first D + 1 parts in a fixed order of all part sketches.

Shingles that many documents share are dealt to parts of their own, which stand last
in that order; the order decides what is compared and never what is found. A document
with too few parts for the guarantee also gives its first D + 1 shingles singly.

1. Every text is hashed once for its set's size, digest, bit sketch and a few minima.
   Equal sets are one node from here on.
2. Nodes that agree in minima are compared with the nearest of them. What links makes
   clusters; this finds no more than the join would, it only saves the join work.
3. Nodes sign with the name of their cluster, so that a group of near copies meets
   itself once and not in all pairs. Clusters that share a part sketch are candidates.
4. Clusters that sizes and bit sketches (of one node each, less the distances of the
   others from it) keep apart are not. Of two others the nodes whose sizes or bit sketches do not already exceed the
   bound are compared by all shingles: first the nearest pair, then, if the clusters are
   still apart, every other one. Hence no class is missed.
5. All links lie inside classes. To count them, a class is cut into blocks of bounded
   size, and each cell of two blocks counts the common shingles of all its pairs.

Shingles go by 64-bit hashes of their words, so a false link would take many colliding
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TOKENS, checkpointed, map_arrow, share, table

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Groups up to this size give all pairs; shingles held hot at most, and seen so often by one task to be offered.
SMALL, HOT, OFTEN = 8, 1 << 17, 8
#: Numbers of 64 bits in the bit sketch of a whole set, and pairs of minima by which clusters are looked for.
BITS64, MINIMA = 16, 8
#: Entries that a map task sorts together, characters of text hashed together, and entries of a bucket, about.
FLUSH, CHARS, BUCKET = 1 << 20, 1 << 20, 1 << 20
#: Texts hashed together at most (each takes a place for every bit of its sketch).
ROWS = 1 << 10
#: Buckets at most.
BUCKETS = 1 << 17
#: Rows (two numbers) that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 19
#: Edges that a task of the components' rounds reads, about.
EDGES = 1 << 16
#: Nodes and shingles of a block when links are counted, about.
BLOCK_NODES, BLOCK_SHINGLES = 1 << 11, 1 << 20
#: Odd multipliers (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: The bytes between words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SKETCH = [f"s{i}" for i in range(BITS64)]
KEYS = [f"k{i}" for i in range(MINIMA)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[3]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def _word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, eight bytes at a time for all of them, and where they start."""
    n = len(blob)
    padded = blob + bytes(8)
    solid = ~SPACE[np.frombuffer(padded, np.uint8, n)]
    turn = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = turn[::2], turn[1::2]
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) * MIX[2])
    for k in range(0, 64, 8):
        at = np.flatnonzero(length > k) if k else slice(None)
        begin, rest = start[at] + k, np.minimum(length[at] - k, 8)
        if not len(begin):
            break
        block = eight[begin] & (np.uint64(2**64 - 1) >> (np.uint64(64) - rest.astype(np.uint64) * np.uint64(8)))
        h[at] = mix(h[at] ^ block * MIX[4])
    for i in np.flatnonzero(length > 64):
        h[i] = int.from_bytes(hashlib.blake2b(blob[start[i] : end[i]], digest_size=8).digest(), "little")
    return h, start


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after the other, and where each text's begin and end.

    Of fewer words than a shingle's the whole sequence is one; null has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(TOKENS) for t in texts]
    h, start = _word_hashes(b" ".join(raw))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    words = np.diff(first)
    doc = np.repeat(np.arange(len(raw)), words)
    n = max(0, len(h) - SHINGLE + 1)
    value = np.full(n, SHINGLE * int(MIX[5]) & 2**64 - 1, np.uint64)
    for i in range(SHINGLE):  # words' hashes are random already, and each place has its own factor
        value += h[i : i + n] * MIX[i]
    full = np.arange(n) + SHINGLE <= first[1:][doc[:n]]
    value, doc = mix(value[full]), doc[:n][full]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        whole = [np.uint64((int(words[d]) * int(MIX[5]) + sum(int(x) * int(m) for x, m in zip(h[first[d] : first[d + 1]], MIX, strict=False))) & 2**64 - 1) for d in short]
        value, doc = np.concatenate([value, mix(np.array(whole, np.uint64))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    at = np.searchsorted(doc, np.arange(len(raw) + 1))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[i:j].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(raw) + 1))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's shingles."""
    return shingle_sets([text])[0]


def _portions(keys: list, texts: list) -> Iterator[tuple[list, list]]:
    """The same rows in runs of about CHARS characters and of ROWS rows at most."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t or "") > CHARS or i - lo == ROWS):
            yield keys[lo:i], texts[lo:i]
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield keys[lo:], texts[lo:]


def most_differences(n: int, m: int) -> int:
    """Shingles that only one of two linked documents of n and m shingles has, at most."""
    return (100 - PERCENT) * (n + m) // (100 + PERCENT)


def largest_partner(n: int) -> int:
    return n * 100 // PERCENT


def bit_sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set and each of 64 * BITS64 bits whether an odd number of the hashes falls on it."""
    bits, k = 64 * BITS64, len(at) - 1
    row = np.repeat(np.arange(k), np.diff(at))
    odd = np.bincount(row * bits + (h >> np.uint64(8)).astype(np.int64) % bits, minlength=k * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(k, BITS64)


def bit_sketch(h: np.ndarray) -> np.ndarray:
    return bit_sketches(h, np.array([0, len(h)]))[0]


def long_sketch(h: np.ndarray) -> bytes | None:
    """The same in as many bits as a larger set has shingles, rounded up to a power of two."""
    if len(h) <= 64 * BITS64:
        return None
    bits = 1 << (len(h) - 1).bit_length()
    odd = np.bincount((h >> np.uint64(8)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def long_bits_apart(one: bytes, two: bytes) -> int:
    """The bits in which two long sketches differ, the longer one folded to the other's length."""
    x, y = sorted((np.frombuffer(b, np.uint64) for b in (one, two)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two sums of remixed hashes for each set, as signed numbers."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for i, m in enumerate((MIX[0], MIX[2])):
            out[some, i] = np.add.reduceat(mix(h * m), at[some])
    return out.view(np.int64)


def minima(h: np.ndarray, at: np.ndarray) -> list[list[int | None]]:
    """For each pair of sixteenths of the hash space a key made of the least hashes there; null where both are empty."""
    k, bins = len(at) - 1, 2 * MINIMA
    place = np.repeat(np.arange(k), np.diff(at)) * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    least = np.zeros(k * bins, np.uint64)
    least[place[first]] = h[first]
    two = least.reshape(k * MINIMA, 2)
    key = mix(two[:, 0] * MIX[0] + two[:, 1] * MIX[2] + np.tile(np.arange(MINIMA, dtype=np.uint64), k) * MIX[4]).view(np.int64).astype(object)
    key[(two == 0).all(1)] = None
    return key.reshape(k, MINIMA).T.tolist()


def bits_apart(left: str, right: str) -> Column:
    """The bits in which two sets' sketches, in columns with these prefixes, differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))) for s in SKETCH])


def can_link(left: str, right: str) -> Column:
    """Whether sizes and bit sketches of two sets, in columns with these prefixes, allow a link."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (bits_apart(left, right) * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def bands(n: int) -> Iterator[tuple[int, int]]:
    """The size bands in which a document is sketched: their number and the largest partner there."""
    own, most = band_of(n), largest_partner(n)
    yield own, min(most, 4 ** (own + 1) - 1)
    for higher in range(own + 1, band_of(most) + 1):
        yield higher, most


def place_of(band: int, tag: int) -> np.uint64:
    return np.uint64((band * 4 + tag) * int(MIX[2]) & 2**64 - 1)


def part_sketches(h: np.ndarray, band: int, tag: int) -> np.ndarray:
    """XOR of the sorted hashes in each of the band's parts, mixed with the part's place; empty parts give none.

    There are 1.5 * 4 ** band parts, a few more than the largest sets of the band can differ in.
    """
    if not len(h):
        return h
    part = (h >> np.uint64(32)) * np.uint64(3 * 4**band + 1 >> 1) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    xor = np.bitwise_xor.reduceat(h, first)
    return mix(xor * MIX[0] + part[first] * MIX[1] + place_of(band, tag))


def first_of(rare: np.ndarray, hot: np.ndarray, count: int) -> np.ndarray:
    """The first sketches in the global order: rare before hot, then by value."""
    if len(rare) > count:
        return np.partition(rare, count - 1)[:count]
    if len(rare) + len(hot) > count:
        return np.concatenate([rare, np.partition(hot, count - len(rare) - 1)[: count - len(rare)]]) if count > len(rare) else rare
    return np.concatenate([rare, hot])


def signatures(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What a document is joined by: some sketch of it agrees with one of every document it links to.

    hot says which of the sorted hashes h are common.
    """
    n = len(h)
    rare, common = h[~hot], h[hot]
    out = []
    for band, most in bands(n):
        d = most_differences(n, most)
        a, b = part_sketches(rare, band, 0), part_sketches(common, band, 1)
        out.append(first_of(a, b, d + 1))
        if len(a) + len(b) <= d:
            place = place_of(band, 2)
            out.append(first_of(mix(rare * MIX[4] + place), mix(common * MIX[4] + place), d + 1))
    return np.concatenate(out)


def _describe(docs: DataFrame) -> DataFrame:
    """One row a document with its set's size, digest, sketch and minima, and rows of shingles that tasks saw often."""
    numbers = ["doc_id", "n", "h1", "h2", *SKETCH, *KEYS]

    def run(batches) -> Iterator[dict]:
        kept, waiting = [], 0

        def often() -> dict:
            seen, n = np.unique(np.concatenate(kept), return_counts=True)
            seen, n = seen[n >= OFTEN], n[n >= OFTEN]
            return {c: [None] * len(n) for c in [*numbers, "long"]} | {"n": n, "shingle": seen.view(np.int64)}

        for ids, texts in batches:
            for keys, some in _portions(ids, texts):
                h, at = shingle_sets(some)
                two, bits = digests(h, at), bit_sketches(h, at)
                made = {"doc_id": keys, "n": np.diff(at), "h1": two[:, 0], "h2": two[:, 1], "shingle": [None] * len(keys)}
                made["long"] = [long_sketch(h[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield made | {s: bits[:, i] for i, s in enumerate(SKETCH)} | dict(zip(KEYS, minima(h, at), strict=True))
                kept.append(h)
                waiting += len(h)
                if waiting > 2 * FLUSH:
                    yield often()
                    kept, waiting = [], 0
        if waiting:
            yield often()

    return map_arrow(docs, run, ", ".join(f"{c} long" for c in [*numbers, "shingle"]) + ", long binary")


def _hot(described: DataFrame) -> np.ndarray:
    """The most frequent of the offered shingles, HOT at most: all above the least count, of a fixed scale, that leaves no more."""
    offered = checkpointed(described.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("c")))
    step = F.floor(F.log2("c") * 8)
    total, least = 0, None
    for r in sorted(offered.groupBy(step.alias("step")).count().collect(), reverse=True):  # eight rows for each doubling
        total += r["count"]
        if total > HOT:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.uint64)
    kept = offered.where(step >= least).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(kept.view(np.uint64))


def _narrowed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(label, text) of the documents that rows (id, label) name; a short list is broadcast."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if few else rows, docs.doc_id == rows.id).select("label", "text")


def _groups(sig: np.ndarray, node: np.ndarray):
    """Sorted distinct entries, and the first place and size of each group."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    return sig, node, first, np.diff(np.concatenate([first, [len(sig)]]))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _met(labelled: DataFrame, hot: np.ndarray, shingles: int) -> DataFrame:
    """(sig, a, b): a < b are two labels that met, with a null sig; b is null for the members a of a large group sig.

    An entry is a signature's lower half and a label; its upper half chooses the bucket,
    and a bucket is joined at a time. Two signatures that agree by chance only cost a
    comparison. Repeats occur, between buckets.
    """
    spark = labelled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(4 * parts, shingles // 2 // BUCKET), BUCKETS)
    sent = share(spark, hot)

    def sign(batches) -> Iterator[dict]:
        hot, sigs, labels, waiting = sent(), [], [], 0

        def flush() -> Iterator[dict]:
            sig, label, _, _ = _groups(np.concatenate(sigs), np.concatenate(labels))
            bucket = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # in the order of sig already
            cut = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            ends = [*cut[1:].tolist(), len(sig)]
            narrow = 0 <= label.min() and label.max() < 2**32
            low, label = sig.astype(np.uint32), label.astype(np.uint32) if narrow else label
            yield {
                "bucket": bucket[cut].astype(np.int64), "narrow": [bool(narrow)] * len(cut),
                "sig": [low[i:j].tobytes() for i, j in zip(cut.tolist(), ends, strict=True)],
                "label": [label[i:j].tobytes() for i, j in zip(cut.tolist(), ends, strict=True)],
            }

        for keys, texts in batches:
            for some, part in _portions(keys, texts):
                h, at = shingle_sets(part)
                is_hot = np.zeros(len(h), bool)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                for key, i, j in zip(some, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if j > i:
                        s = signatures(h[i:j], is_hot[i:j])
                        sigs.append(s)
                        labels.append(np.full(len(s), key, np.int64))
                        waiting += len(s)
                if waiting >= FLUSH:
                    yield from flush()
                    sigs, labels, waiting = [], [], 0
        if waiting:
            yield from flush()

    def joined(bucket: int, got: list) -> Iterator[dict]:
        sig, label, first, size = _groups(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(2, SMALL + 1):
            at = first[size == k]
            members, (i, j) = label[at[:, None] + np.arange(k)], np.triu_indices(k, 1)
            left.append(members[:, i].ravel())
            right.append(members[:, j].ravel())
        a, b = _distinct(np.concatenate(left), np.concatenate(right))
        large = np.repeat(size > SMALL, size)
        sig, label = sig[large].astype(np.int64) + (bucket << 32), label[large]
        if len(sig):  # of groups with the same members one is enough
            first = np.flatnonzero(np.diff(sig, prepend=-1))
            size = np.diff(np.append(first, len(sig)))
            sums = [np.add.reduceat(mix(label.view(np.uint64) * m), first) for m in (MIX[0], MIX[2])]
            _, one = np.unique(np.stack([size.astype(np.uint64), *sums], 1), axis=0, return_index=True)
            kept = np.zeros(len(first), bool)
            kept[one] = True
            kept = np.repeat(kept, size)
            sig, label = sig[kept], label[kept]
        step = 1 << 16
        for lo in range(0, len(a), step):
            yield {"sig": [None] * len(a[lo : lo + step]), "a": a[lo : lo + step], "b": b[lo : lo + step]}
        for lo in range(0, len(sig), step):
            yield {"sig": sig[lo : lo + step], "a": label[lo : lo + step], "b": [None] * len(sig[lo : lo + step])}

    def meet(batches) -> Iterator[dict]:
        now, got = None, []
        for buckets, narrow, sigs, labels in batches:  # sorted by bucket
            for bucket, small, sig, label in zip(buckets, narrow, sigs, labels, strict=True):
                if bucket != now and got:
                    yield from joined(now, got)
                    got = []
                now = bucket
                got.append((np.frombuffer(sig, np.uint32), np.frombuffer(label, np.uint32 if small else np.int64).astype(np.int64)))
        if got:
            yield from joined(now, got)

    dealt = map_arrow(labelled, sign, "bucket long, narrow boolean, sig binary, label binary")
    dealt = dealt.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, meet, "sig long, a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link, by the 64-bit hashes of all their shingles; doc_id is unique."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("label", F.col("id"))
    texts = _narrowed(docs, ids)
    both = pairs.join(texts.select(F.col("label").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("label").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches) -> Iterator[dict]:
        for a, b, ta, tb in batches:
            for rows, _ in _portions(list(zip(a, b, ta, tb, strict=True)), tb):
                where: dict[str, int] = {}
                at = [(where.setdefault(s, len(where)), where.setdefault(t, len(where))) for _, _, s, t in rows]
                h, cut = shingle_sets(list(where))
                out = {"a": [], "b": []}
                for (x, y, _, _), (i, j) in zip(rows, at, strict=True):
                    u, v = h[cut[i] : cut[i + 1]], h[cut[j] : cut[j + 1]]
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    if common and 100 * common >= PERCENT * (len(u) + len(v) - common):
                        out["a"].append(x)
                        out["b"].append(y)
                yield out

    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that is reachable.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node among them. Each round is
    checkpointed; stars settle in one. A round reads its edges in as many tasks as
    their number asks for, and broadcasts a number for each node up to BROADCAST_ROWS.
    """

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    now, before = state(edges), None
    while now != before:
        edges = edges.coalesce(now["n"] // EDGES + 1)
        by_node = F.broadcast if 2 * now["n"] <= BROADCAST_ROWS else lambda rows: rows
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        least = ends.groupBy(F.col("e.u").alias("v")).agg(F.min("e.v").alias("m")).select("v", F.least("v", "m").alias("m"))
        # Large neighbours to the least of the whole neighbourhood.
        large = edges.join(by_node(least), "v").select("u", F.col("m").alias("v"))
        # Small neighbours, and the node itself, to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_node(small_least), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = checkpointed(small.where("u <> v").distinct())
        now, before = state(edges), now
    edges = edges.coalesce(now["n"] // EDGES + 1)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _prefixed(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("node", "label", "n", *SKETCH) if c in nodes.columns])


def _named(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Nodes with the label of their cluster; a node without one is its own."""
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _allowed(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that the long sketches (node, long) of their ends allow, where both have one."""
    one, two = [large.select(F.col("node").alias(end), F.col("long").alias(f"long_{end}")) for end in "ab"]
    both = pairs.join(one, "a").join(two, "b")

    def run(batches) -> Iterator[dict]:
        for a, b, sizes, x, y in batches:
            far = [long_bits_apart(u, v) * (100 + PERCENT) > n * (100 - PERCENT) for n, u, v in zip(sizes, x, y, strict=True)]
            yield {"a": [i for i, no in zip(a, far, strict=True) if no], "b": [i for i, no in zip(b, far, strict=True) if no]}

    return pairs.join(map_arrow(both.select("a", "b", "both", "long_a", "long_b"), run, "a long, b long"), ["a", "b"], "left_anti")


def _clusters(nodes: DataFrame, large: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Labels (node, label) after comparing each node with the nearest of those that share minima with it."""
    keyed = nodes.select("node", F.explode(F.array(*KEYS)).alias("key")).where("key is not null")
    hub = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    near = keyed.join(hub, "key").where("node <> hub").select("node", "hub").distinct()
    two = near.join(_prefixed(nodes, "x_"), F.col("node") == F.col("x_node")).join(_prefixed(nodes, "y_"), F.col("hub") == F.col("y_node")).where(can_link("x_", "y_"))
    two = checkpointed(two.select(F.col("node").alias("a"), F.col("hub").alias("b"), bits_apart("x_", "y_").alias("apart"), (F.col("x_n") + F.col("y_n")).alias("both")))
    best = checkpointed(_allowed(two, large).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
    links = checkpointed(_verify(best, docs))
    return None if links.isEmpty() else checkpointed(components(links))


def _balls(nodes: DataFrame) -> DataFrame:
    """One row a cluster: its least and largest sizes, its first node's sketch, and the largest distance of a sketch from that."""
    x, y = _prefixed(nodes, "x_"), _prefixed(nodes.where("node = label"), "y_")
    both = x.join(y, F.col("x_label") == F.col("y_label"))
    sizes = [F.min("x_n").alias("lo"), F.max("x_n").alias("hi"), F.max(bits_apart("x_", "y_")).alias("r")]
    return both.groupBy(F.col("x_label").alias("label")).agg(*sizes, *[F.first(f"y_{s}").alias(s) for s in SKETCH])


def _in_large_groups(members: DataFrame, balls: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters in one of the groups (sig, a) whose sizes and sketches allow a link between nodes of theirs.

    A group is cut into blocks of clusters, of which each cell compares two.
    """
    inside = members.join(balls, members.a == balls.label).select("sig", F.col("label").alias("node"), "lo", "hi", "r", F.array(*SKETCH).alias("bits"))
    blocks = inside.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
    dealt = _celled(inside.join(blocks, "sig"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["block"] == rows["i"]], rows[rows["block"] == rows["j"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64")})
        x, y = [np.stack(r["bits"]).astype(np.int64).view(np.uint64) for r in (one, two)]
        (a, lo, hi, r), (b, lo2, hi2, r2) = [[t[c].to_numpy() for c in ("node", "lo", "hi", "r")] for t in (one, two)]
        left, right = [], []
        for at in range(0, len(a), 64):
            part = slice(at, at + 64)
            apart = np.bitwise_count(x[part, None, :] ^ y[None]).sum(2, dtype=np.int64) - r[part, None] - r2[None]
            most = hi[part, None] + hi2[None]
            good = (hi[part, None] * 100 >= lo2[None] * PERCENT) & (hi2[None] * 100 >= lo[part, None] * PERCENT)
            p, q = np.nonzero(good & (apart * (100 + PERCENT) <= most * (100 - PERCENT)) & (a[part, None] != b[None]))
            left.append(a[part][p])
            right.append(b[q])
        p, q = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

    return dealt.groupBy("sig", "i", "j").applyInPandas(run, "a long, b long")


def _celled(rows: DataFrame) -> DataFrame:
    """Rows (node, blocks, ...) once for each cell (i, j), i <= j, of blocks that the row's own block has a part in."""
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _searched(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """For (doc_id, text) with unique ids, but for null: what _describe says, the sets as nodes, the rows' nodes, and the labels of all links."""
    described = checkpointed(_describe(docs))
    hot = _hot(described)
    info = described.where("shingle is null")
    full = info.where("n > 0 and doc_id is not null")
    nodes = checkpointed(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in (*SKETCH, *KEYS, "long")]))
    large = nodes.where("long is not null").select("node", "long")
    member = checkpointed(full.select("doc_id", "n", "h1", "h2").join(nodes.select("n", "h1", "h2", "node"), ["n", "h1", "h2"]).select("doc_id", "n", "node"))
    docs = docs.where("doc_id is not null")

    labels = _clusters(nodes, large, docs)
    nodes = checkpointed(_named(nodes.select("node", "n", *SKETCH), labels))
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    met = checkpointed(_met(_narrowed(docs, nodes.select(F.col("node").alias("id"), "label")), hot, shingles))

    # Pairs of clusters that sizes and sketches allow, and then of their nodes.
    balls = checkpointed(_balls(nodes))
    one, two = [balls.select(*[F.col(c).alias(f"{side}{c}") for c in balls.columns]) for side in "xy"]
    near = (F.col("xhi") * 100 >= F.col("ylo") * PERCENT) & (F.col("yhi") * 100 >= F.col("xlo") * PERCENT)
    near &= (bits_apart("x", "y") - F.col("xr") - F.col("yr")) * (100 + PERCENT) <= (F.col("xhi") + F.col("yhi")) * (100 - PERCENT)
    labelled = met.where("sig is null").select("a", "b").distinct()
    labelled = labelled.join(one, F.col("a") == F.col("xlabel")).join(two, (F.col("b") == F.col("ylabel")) & near).select("a", "b")
    members = met.where("sig is not null").select("sig", "a")
    if not members.isEmpty():
        members = members.distinct()
        # Of groups with the same members one is enough.
        sums = members.groupBy("sig").agg(F.count("a").alias("size"), *[F.sum(F.xxhash64(F.lit(k), "a").cast("decimal(38,0)")).alias(f"k{k}") for k in (0, 1)])
        kept = sums.groupBy("size", "k0", "k1").agg(F.min("sig").alias("sig")).select("sig")
        labelled = labelled.union(_in_large_groups(members.join(kept, "sig"), balls)).distinct()
    labelled = checkpointed(labelled)
    x, y = _prefixed(nodes, "x_"), _prefixed(nodes, "y_")
    # A node of one cluster goes on only if it is near enough to the other cluster as a whole.
    facing = labelled.join(two, F.col("b") == F.col("ylabel"))
    fits = (F.col("x_n") * 100 >= F.col("ylo") * PERCENT) & (F.col("yhi") * 100 >= F.col("x_n") * PERCENT)
    fits &= (bits_apart("x_", "y") - F.col("yr")) * (100 + PERCENT) <= (F.col("x_n") + F.col("yhi")) * (100 - PERCENT)
    some = facing.join(x, (F.col("a") == F.col("x_label")) & fits).select("b", *x.columns)
    pairs = some.join(y, (F.col("b") == F.col("y_label")) & can_link("x_", "y_"))
    ends = pairs.select("x_node", "x_label", "x_n", *[f"x_{s}" for s in SKETCH], "y_node", "y_label", "y_n", *[f"y_{s}" for s in SKETCH])
    ends = ends.withColumns({"a": F.least("x_node", "y_node"), "b": F.greatest("x_node", "y_node")})
    ends = checkpointed(ends.select("a", "b", F.col("x_label").alias("la"), F.col("y_label").alias("lb"), bits_apart("x_", "y_").alias("apart"), (F.col("x_n") + F.col("y_n")).alias("both")))
    pairs = checkpointed(_allowed(ends, large))
    nearest = pairs.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
    for part in (nearest, None):
        if part is None:  # all other pairs that are still apart
            left, right = [labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")) for end in "ab"] if labels is not None else (None, None)
            part = pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti")
            if labels is not None:
                part = part.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        part = checkpointed(part)
        if not part.isEmpty():
            links = checkpointed(_verify(part, docs))
            if not links.isEmpty():
                labels = checkpointed(components(links if labels is None else links.union(labels.select("node", "label"))))
    return info, nodes.select("node", "n"), member, labels


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, key, text), what to search of it, and whether some doc_id has several rows; a key stands for one text of one doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")) if repeated else F.col("doc_id")
    rows = docs.select("doc_id", key.alias("key"), "text")
    keyed = rows.select(F.col("key").alias("doc_id"), "text")
    if repeated:  # rows without an id have no key
        keyed = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.first("text").alias("text"))
    return rows, keyed, repeated


def _by_row(rows: DataFrame, info: DataFrame, member: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, n_shingles, node) for every row; rows that can link with nothing have no node."""
    known = info.select(F.col("doc_id").alias("key"), "n").join(member.select(F.col("doc_id").alias("key"), "node"), "key", "left")
    if repeated:
        alone = _describe(rows.where("key is null").select(F.col("key").alias("doc_id"), "text")).where("shingle is null")
        named = rows.where("key is not null").select("doc_id", "key").join(known, "key").select("doc_id", "n", "node")
        known = named.union(alone.select("doc_id", "n", F.lit(None).cast("long")))
    return checkpointed(known.select(F.col("key").alias("doc_id") if not repeated else F.col("doc_id"), F.col("n").alias("n_shingles"), "node"))


def _classed(rows: DataFrame, labels: DataFrame | None, repeated: bool) -> DataFrame:
    """(doc_id, component_id) for the documents that have a node, where the sets of one doc_id are linked too."""
    member = rows.where("node is not null").select("doc_id", "node").distinct()
    if repeated:
        held = member.groupBy("doc_id").agg(F.min("node").alias("one"))
        same = held.join(member, "doc_id").select(F.col("one").alias("a"), F.col("node").alias("b")).where("a <> b")
        joined = same if labels is None else same.union(labels.select("node", "label"))
        labels = checkpointed(components(joined))
    classed = _named(member, labels).select("doc_id", "label").distinct()
    return classed.join(classed.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def similar_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), one row for each document row.

    component_id is the smallest doc_id reachable by links, the document's own
    included. Null and empty texts have no shingles and link with nothing; a null
    doc_id stays alone, with a null component. Rows with one doc_id are one document
    that links where any of them does. Other columns are not read. Only as many links
    are verified as the classes take; linked_classes() counts them all.
    """
    rows, keyed, repeated = _keyed(docs)
    info, _, member, labels = _searched(keyed)
    by_row = _by_row(rows, info, member, repeated)
    out = by_row.join(_classed(by_row, labels, repeated), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _common(u: np.ndarray, at_u: np.ndarray, v: np.ndarray, at_v: np.ndarray) -> np.ndarray:
    """The number of common shingles of every set of one list with every set of another.

    A shingle that few of the sets have is counted pair by pair, one that many have as
    a bit of each set, whichever is less work.
    """
    rows, cols = len(at_u) - 1, len(at_v) - 1
    shingles, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    du, dv = np.bincount(place[: len(u)], minlength=len(shingles)), np.bincount(place[len(u) :], minlength=len(shingles))
    work = du * dv
    dense = work * 512 > rows * cols
    row = [np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (at_u, at_v)]
    of = [place[: len(u)], place[len(u) :]]
    out = np.zeros(rows * cols, np.int32)
    # Shingles of few sets: all pairs of their holders.
    few = (work > 0) & ~dense
    by_col = [np.argsort(p, kind="stable") for p in of]
    held = [p[o] for p, o in zip(of, by_col, strict=True)]
    left = by_col[0][few[held[0]]]
    start = np.searchsorted(held[1], of[0][left])
    times = dv[of[0][left]]
    step = np.flatnonzero(np.diff(np.cumsum(times) // (1 << 20), prepend=-1)) if len(times) else np.empty(0, np.int64)
    for lo, hi in zip(step.tolist(), [*step[1:].tolist(), len(times)], strict=False):
        t = times[lo:hi]
        at = np.repeat(start[lo:hi] - np.concatenate([[0], np.cumsum(t)[:-1]]), t) + np.arange(t.sum())
        code = np.repeat(row[0][left[lo:hi]], t) * cols + row[1][by_col[1][at]]
        found, n = np.unique(code, return_counts=True)
        out[found] += n.astype(np.int32)
    out = out.reshape(rows, cols)
    # Shingles of many sets: 64 at a time.
    number = np.cumsum(dense) - 1
    words = int(dense.sum() + 63) // 64
    bits = []
    for r, p, k in zip(row, of, (rows, cols), strict=True):
        on = dense[p]
        flags = np.zeros((k, words * 64), np.uint8)
        flags[r[on], number[p[on]]] = 1
        bits.append(np.packbits(flags, axis=1).view(np.uint64) if words else np.zeros((k, 0), np.uint64))
    for w in range(words):
        for lo in range(0, rows, 512):
            out[lo : lo + 512] += np.bitwise_count(bits[0][lo : lo + 512, None, w] & bits[1][None, :, w])
    return out


def _counted(nodes: DataFrame, labels: DataFrame, weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, ones, other) over all links of the nodes: ones is the sum of what linked nodes weigh, in several rows.

    Links that have a marked (several) node at an end also come one by one, as other, both ways.
    """
    inside = _named(nodes, labels).join(weights, "node")
    size = inside.groupBy("label").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("s")).where("g > 1")
    blocks = F.ceil(F.greatest(F.col("g") / BLOCK_NODES, F.col("s") / BLOCK_SHINGLES))
    dealt = inside.join(size.select("label", blocks.alias("blocks")), "label").select("label", "node", "n", "weight", "several", "blocks")
    texts = _narrowed(docs, dealt.select(F.col("node").alias("id"), F.col("node").alias("label"))).withColumnRenamed("label", "node")
    rows = _celled(dealt.join(texts, "node"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["block"] == rows["i"]], rows[rows["block"] == rows["j"]]
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        if not len(one) or not len(two):
            return pd.DataFrame({c: pd.array([], "Int64") for c in ("node", "ones", "other")})
        (u, at_u), (v, at_v) = [_all_sets(r["text"].tolist()) for r in (one, two)]
        common = _common(u, at_u, v, at_v)
        n, m = np.diff(at_u), np.diff(at_v)
        linked = np.empty(common.shape, bool)
        for lo in range(0, len(n), 512):
            c = common[lo : lo + 512].astype(np.int64)
            linked[lo : lo + 512] = (c > 0) & (100 * c >= PERCENT * (n[lo : lo + 512, None] + m[None] - c))
        if same:
            np.fill_diagonal(linked, False)
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        out = [(a, linked @ two["weight"].to_numpy(), None)]
        if not same:
            out.append((b, one["weight"].to_numpy() @ linked, None))
        p, q = np.nonzero(linked & (one["several"].to_numpy()[:, None] | two["several"].to_numpy()[None]))
        for x, y in [(a[p], b[q])] + ([] if same else [(b[q], a[p])]):
            out.append((x, np.zeros(len(x), np.int64), y))
        return pd.concat([pd.DataFrame({"node": x, "ones": c, "other": pd.array(o if o is not None else [None] * len(x), "Int64")}) for x, c, o in out])

    return rows.groupBy("label", "i", "j").applyInPandas(run, "node long, ones long, other long")


def _all_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    parts = [shingle_sets(some) for some, _ in _portions(texts, texts)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def linked_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, n_links), one row for each document row.

    As similar_classes(), but of all links: n_links is the number of other doc_ids
    that the document links with.
    """
    rows, keyed, repeated = _keyed(docs)
    info, nodes, member, labels = _searched(keyed)
    by_row = _by_row(rows, info, member, repeated)
    held = by_row.where("node is not null").select("doc_id", "node")
    if repeated:
        held = held.distinct()
        held = checkpointed(held.join(held.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("several")), "doc_id"))
    else:
        held = held.withColumn("several", F.lit(False))
    weights = held.groupBy("node").agg(F.sum((~F.col("several")).cast("long")).alias("weight"), F.max("several").alias("several"))
    own = weights.select("node", F.col("weight").alias("ones"), F.when(F.col("several"), F.col("node")).alias("other"))
    reached = own if labels is None else own.union(_counted(nodes, labels, weights, keyed))
    if not repeated:
        counts = held.join(reached.groupBy("node").agg((F.sum("ones") - 1).alias("n_links")), "node").select("doc_id", "n_links")
    else:
        reached = checkpointed(reached)
        # Documents of one set: those of several that they reach are counted once, whichever of their sets it is by.
        marked = held.where("several").select(F.col("node").alias("other"), F.col("doc_id").alias("via"))
        plain = held.where("not several").join(reached, "node")
        ones = plain.groupBy("doc_id").agg(F.sum("ones").alias("x"))
        others = plain.join(marked, "other").groupBy("doc_id").agg(F.count_distinct("via").alias("y"))
        # Documents of several sets reach a set once, whichever of theirs it is by.
        sets = held.where("several").select("doc_id", "node").join(reached.where("other is not null"), "node").select("doc_id", "other").distinct()
        own_ones = sets.join(weights.select(F.col("node").alias("other"), "weight"), "other").groupBy("doc_id").agg(F.sum("weight").alias("x"))
        own_others = sets.join(marked, "other").groupBy("doc_id").agg(F.count_distinct("via").alias("y"))
        both = ones.join(others, "doc_id", "left").union(own_ones.join(own_others, "doc_id", "left"))
        counts = both.select("doc_id", (F.col("x") + F.coalesce("y", F.lit(0)) - 1).alias("n_links"))
    out = by_row.select("doc_id", "n_shingles").join(_classed(by_row, labels, repeated), "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op7_jaccard_classes(spark, sf_dir: str) -> DataFrame:
    """The class of every document under links of 0.75 or more, and the number of its links."""
    return linked_classes(table(spark, sf_dir, "documents"))
