"""Benchmark decontamination by a prefix-filtered containment join.

Every window of ten consecutive item words must lie in a document whole, so all of
its shingles must occur there; with the full set required, the prefix that a window
has to share is a single shingle. Shingles of the benchmark are ordered by how often
they occur in the corpus, each window is indexed under its rarest one, and documents
are probed with that index only. A probe that matches fixes the window's place: the
positional bound (the window must begin inside the text) and the length bound (it
must end there) drop candidates, and comparing all words verifies the rest.

The benchmark's vocabulary and windows are broadcast in blocks of bounded size. One
block is the usual case; beyond it the documents pass through one scan for each
block, with a checkpoint between, so memory never grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORDS, checkpointed, map_arrow, share, split, table

#: Words of a window, and of the shingles that windows are indexed by.
WINDOW, SHINGLE = 10, 3
#: Bytes of item texts that one broadcast may hold.
BLOCK_BYTES = 4 << 20
#: Candidates that are compared at once.
CHUNK = 1 << 16
#: Odd multipliers that mix word numbers into a shingle's key (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """Mixed keys of all runs of `size` word numbers; collisions are sorted out by verification."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = ids.astype(np.uint64)
    key = wide[:n] * MIX[0]
    for k in range(1, size):
        key = (key ^ (key >> np.uint64(29))) + wide[k : k + n] * MIX[k]
    return key


class Windows:
    """The distinct windows of a block of items, and their shingles by size."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                ids_of = found.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    ids_of.add(item)
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(x) for x in found], np.int64)
        self.words = np.zeros((len(found), window), np.int32)
        for k, x in enumerate(found):
            self.words[k, : len(x)] = x
        self.window = window
        # For each size of shingle: sorted distinct keys, and of each window the numbers of its own.
        self.sizes, self.keys, self.own = [], [], []
        for size in range(1, shingle + 1):
            rows = np.flatnonzero(np.minimum(self.length, shingle) == size)
            if len(rows):
                per = [shingle_keys(self.words[r, : self.length[r]], size) for r in rows]
                keys = np.unique(np.concatenate(per))
                self.sizes.append(size)
                self.keys.append(keys)
                self.own.append([(r, np.searchsorted(keys, p)) for r, p in zip(rows.tolist(), per, strict=True)])

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def occurrences(self, ids: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and key numbers of the indexed shingles of one size in a document."""
        size, keys = self.sizes[which], self.keys[which]
        known = ids > 0
        full = known[: len(ids) - size + 1].copy() if len(ids) >= size else np.zeros(0, bool)
        for k in range(1, size):
            full &= known[k : k + len(full)]
        at = np.flatnonzero(full)
        if not len(at):
            return at, at
        key = shingle_keys(ids, size)[at]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[place] == key
        return at[ok], place[ok]

    def choose(self, counts: list[np.ndarray]) -> None:
        """Index every window under its rarest shingle: per key the (offset, window) pairs, as ranges of two flat arrays."""
        self.index = []
        for own, keys, count in zip(self.own, self.keys, counts, strict=True):
            rows = np.array([w for w, _ in own])
            offsets = np.array([int(np.lexsort((p, count[p]))[0]) for _, p in own])
            chosen = np.array([p[o] for (_, p), o in zip(own, offsets, strict=True)])
            order = np.argsort(chosen, kind="stable")
            begin = np.searchsorted(chosen[order], np.arange(len(keys) + 1))
            self.index.append((begin, offsets[order], rows[order]))
        self.own = []

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: start positions and windows."""
        starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        n = len(ids)
        padded = np.concatenate([ids, np.zeros(self.window, np.int32)])
        for which, (begin, offset, row) in enumerate(self.index):
            at, place = self.occurrences(ids, which)
            per = begin[place + 1] - begin[place]
            at, place, per = at[per > 0], place[per > 0], per[per > 0]
            ends = np.cumsum(per)
            lo = 0
            while lo < len(at):  # so many candidates at once, whatever the text's length
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
                reps = per[lo:hi]
                entry = np.repeat(begin[place[lo:hi]] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                start, w = np.repeat(at[lo:hi], reps) - offset[entry], row[entry]
                fits = (start >= 0) & (start + self.length[w] <= n)
                start, w = start[fits], w[fits]
                text = padded[start[:, None] + np.arange(self.window)]
                same = ((text == self.words[w]) | (np.arange(self.window) >= self.length[w][:, None])).all(axis=1)
                starts.append(start[same])
                windows.append(w[same])
                lo = hi
        return np.concatenate(starts), np.concatenate(windows)


def _count_shingles(docs: DataFrame, held, sizes: int) -> list[tuple[int, int, int]]:
    """Occurrences in the corpus of each shingle in the broadcast; counts are combined before the shuffle."""

    def count(batches) -> Iterator[dict]:
        index = held()
        sums = [np.zeros(len(k), np.int64) for k in index.keys]
        for (texts,) in batches:
            for text in texts:
                if ids := split(text, WORDS):
                    ids = index.number(ids)
                    for which in range(sizes):
                        _, place = index.occurrences(ids, which)
                        sums[which] += np.bincount(place, minlength=len(sums[which]))
        for which, s in enumerate(sums):
            seen = np.flatnonzero(s)
            yield {"which": [which] * len(seen), "key": seen, "n": s[seen]}

    counted = map_arrow(docs.select("text"), count, "which int, key int, n long")
    # At most one row for each shingle of a block of BLOCK_BYTES.
    return [tuple(r) for r in counted.groupBy("which", "key").agg(F.sum("n").alias("n")).collect()]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


SCHEMA = "text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where documents (text) hold windows of items (item_id, text).

    One row for each document row: the columns `keep`, text, n_words, spans (merged [start, end)
    word ranges inside occurrences) and items (ids as strings, sorted, distinct).
    Null and empty texts have no words and no hits; repeated documents stay repeated;
    items without words take no part, those with a null id hit but are not listed;
    repeated items count once.
    An empty benchmark leaves every document clean. Other columns are not read.
    """
    spark = docs.sparkSession
    items = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])
    found = docs.select(*keep, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        # Bounded by block_bytes, give or take how evenly the texts hash.
        texts = [(i, w) for i, t in mine.collect() if (w := split(t, WORDS))]
        index = Windows(texts, window, shingle)
        if index.sizes:
            held = share(spark, index)
            counts = [np.zeros(len(k), np.int64) for k in index.keys]
            for which, key, n in _count_shingles(docs, held, len(index.sizes)):
                counts[which][key] = n
            index.choose(counts)
        probe = share(spark, index)

        def scan(batches, probe=probe) -> Iterator[dict]:
            index = probe()
            for *kept, texts, _, spans, hits in batches:
                out = dict(zip(keep, kept, strict=True)) | {"text": texts, "n_words": [], "spans": [], "items": []}
                for text, span, hit in zip(texts, spans, hits, strict=True):
                    words = split(text, WORDS)
                    span, hit = [(x["start"], x["end"]) for x in span], set(hit)
                    if index.sizes and words:
                        start, w = index.find(index.number(words))
                        span += zip(start.tolist(), (start + index.length[w]).tolist(), strict=True)
                        hit.update(i for k in np.unique(w).tolist() for i in index.items[k])
                    out["n_words"].append(len(words))
                    out["spans"].append([{"start": s, "end": e} for s, e in _merge(span)])
                    out["items"].append(sorted(hit))
                yield out

        if b:
            found = checkpointed(found)
        found = map_arrow(found, scan, schema)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of those rows of docs that hold no window of an item."""
    found = contamination(docs, items, [c for c in columns if c != "text"])
    return found.where(F.size("spans") == 0).select(*columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits of every benchmark window in every document, as counts and a digest of the items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, list_slice(ws, p, least(p + 9, len(ws))) AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM i WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM wins),
d AS (SELECT doc_id, len(ws) AS n_words, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM w, lens WHERE len(ws) >= n),
hits AS (SELECT DISTINCT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, list_slice(ws, p, p + n - 1) AS win FROM d) JOIN wins USING (win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS s FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
