"""Text operators against brute force, the tokenizer's library and exact round trips, with the edge cases of each."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, lm, pieces, tokens, toxicity
from tidemark.llm.common import TOKENS, WORDS, map_arrow, split, worker_cache

DOCS = "doc_id long, text string, n_words string, items int"
PATH = tokens.model_path()


def table(spark, rows):
    """(id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def words(n, seed=0, vocab=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def windows(items):
    out = {}
    for i, t in items:
        w = split(t, WORDS)
        if w:
            for k in range(max(1, len(w) - 9)):
                out.setdefault(tuple(w[k : k + 10]), set()).update([] if i is None else [str(i)])
    return out


def brute_contamination(docs, items):
    wins, out = windows(items), []
    for i, t in docs:
        w = split(t, WORDS)
        hit, its = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    its |= ids
        out.append((i, len(w), len(hit), ",".join(sorted(its))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    a, b = words(30, 1), words(12, 2)
    items = [(1, " ".join(a)), (2, " ".join(b)), (10, "Only Three-words"), (2, " ".join(b)), (None, " ".join(a)), (None, "only nameless"), (4, None), (5, ""), (6, "uno")]
    docs = [(1, "x " + " ".join(a[5:17]) + " y"), (2, " ".join(a).upper()), (3, " ".join(b + b)), (4, "only three words, only three words"), (5, None), (6, ""), (7, " ".join(a[:9])), (7, " ".join(a[:9])), (None, "uno"), (9, "x only nameless"), (8, " ".join(words(20000, 3)) + " " + " ".join(b))]
    found = decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_bytes=block)
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), ",".join(r["items"])) for r in found.collect()), key=repr)
    assert got == brute_contamination(docs, items)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in decontaminate.contamination(table(spark, [(1, "a b")]), none, ["doc_id"]).collect()] == [2]
    assert decontaminate.contamination(table(spark, []), none, ["doc_id"]).count() == 0
    assert decontaminate.keep_clean(table(spark, [(1, "a b")]), none, ["doc_id", "text"]).count() == 1


HARD = ["", " ", "  a", "a  b\n\n  c", "▁x▁▁y", "\t\r\x00é", "梦🙂 <s> </s> <unk> <0x41>", "x" * 3000, " " * 300 + "z", "\n", " \n", "ññ" * 300, None]


def texts():
    rng = random.Random(5)
    return HARD + ["".join(rng.choice("ab the 🙂\n▁é<s>0x") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_pieces_are_the_library_s(spark):
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec(PATH)
    known = [t for t in texts() if t is not None]
    ids = codec.encode(known)
    assert ids == sp.encode(known, num_threads=1)
    assert [codec.decode(x) for x in ids] == [t.replace("▁", " ") for t in known]
    assert codec.decode([1, 3 + 0xFF, 2]) == "\ufffd" and codec.decode(None) == ""


def test_coding_documents(spark):
    docs = table(spark, list(enumerate(texts())) + [(None, "a"), (0, "")])
    ids = pieces.encode_documents(docs, PATH)
    back = {r.doc_id: r.text for r in pieces.decode_documents(ids.where("doc_id > 0"), PATH).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts()) if i}
    rows = pieces.round_trip(docs, PATH).collect()
    assert len(rows) == len(texts()) + 2 and all(r.restored for r in rows)
    assert pieces.round_trip(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("head", [0, 40, tokens.HEAD])
def test_token_counts(spark, head):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    given = [*enumerate(texts()), (1, "one id\ttwice"), (1, "one id\ttwice"), (None, "no id"), (None, None), (-1, "x" * 200_000 + " " + "y" * 40), (-2, "y" * 40 + "\n" + " y" * 40)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(table(spark, given), PATH, head).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in given), key=repr)
    assert tokens.count_tokens(table(spark, []), PATH, head).count() == 0


def test_pretokens_are_distinct(spark):
    docs = table(spark, [(k, f"the same words {k % 3} " + "z" * 50) for k in range(30)])
    rows = tokens.with_pieces(tokens.word_counts(docs), PATH).collect()
    assert len({r.key for r in rows}) == len(rows) == 7 and sum(r.c for r in rows) == 150
    assert len(tokens.most_frequent(spark.createDataFrame(rows), 4)) == 4


def brute_classes(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = split(t, TOKENS)
        if i is not None:
            sets.setdefault(i, []).append(set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= 75 * len(a | b) and a and b for a in sets[i] for b in sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}


def near(base, changes, rng):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("hot", [True, False])
def test_jaccard_classes(spark, hot, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 2 if hot else 10**9)
    rng = random.Random(9)
    bases = [words(rng.choice([5, 6, 8, 12, 20, 30, 60, 130, 250]), k, 4000) for k in range(40)]
    shared = words(60, 99, 4000)
    rows = [" ".join(near(b, rng.randrange(0, max(2, len(b) // 25 + 2)), rng)) for b in bases for _ in range(rng.choice([1, 2, 3, 12]))]
    rows += [" ".join(shared + words(rng.randrange(1, 40), 1000 + k)) for k in range(40)]
    rows += ["", None, " \n", "a b", "A B", "a b c d", rows[0], rows[0].upper(), rows[3] + " x", " ".join(words(20000, 7)), " ".join(words(20000, 7)) + " z"]
    docs = [(i * 3 - 50, t) for i, t in enumerate(rows)] + [(None, rows[0]), (-50, rows[0]), (-50, rows[30])]
    got = jaccard.similar_classes(table(spark, docs).repartition(3)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_classes(docs)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_shingles for r in got}[-50 + 3 * rows.index("a b c d")] == 1


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = split(t, TOKENS)
        sets.setdefault(i, []).append(set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    links = {i: 0 for i in sets}
    for i in sets:
        for j in sets:
            links[i] += i != j and None not in (i, j) and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j])
    return links


@pytest.mark.parametrize("repeats", [False, True])
def test_jaccard_links(spark, repeats, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 1 << 12 if repeats else 20)
    rng = random.Random(3)
    base = words(120, 1, 4000)
    rows = [" ".join(near(base, rng.randrange(0, 7), rng)) for _ in range(60)]
    for k in range(8):
        some = words(rng.choice([5, 12, 40]), k + 50, 4000)
        rows += [" ".join(near(some, rng.randrange(0, 2), rng)) for _ in range(4)]
    rows += ["", None, "a b", "A B", rows[0], rows[0].upper()]
    docs = list(enumerate(rows)) + [(None, rows[0])]
    if repeats:
        docs += [(3, rows[3]), (4, rows[70]), (5, ""), (70, rows[65]), (None, "")]
    got = jaccard.linked_classes(table(spark, docs).repartition(3)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.n_links for r in got} == brute_links(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_classes(docs)
    assert max(r.n_links for r in got) > jaccard.SMALL


def test_common_shingles_of_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(0, 10**6, 20)])).astype(np.uint64) for _ in range(90)]
    lists = [sets[:50], sets[30:]]
    u, v = [(np.concatenate(x), np.concatenate([[0], np.cumsum([len(s) for s in x])])) for x in lists]
    assert jaccard._common(*u, *v).tolist() == [[len(np.intersect1d(a, b)) for b in lists[1]] for a in lists[0]]


def test_shingle_sets_of_many_texts():
    texts = ["", None, "A b  C", "x" * 70 + " y" * 9, "a b c d e f g", "é ü\x0bq w e", "a b c d e f g a b c d e f g"]
    flat, at = jaccard.shingle_sets(texts)
    sets = [set(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [0, 0, 1, 2, 3, 1, 7] and sets[4] < sets[6]
    assert [set(jaccard.shingle_hashes(t).tolist()) for t in texts] == sets


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_classes(table(spark, [])).count() == 0
    assert [r.component_id for r in jaccard.similar_classes(table(spark, [(4, None), (2, "")])).orderBy("doc_id").collect()] == [2, 4]


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 15).astype(np.uint64)]))
        apart = np.unpackbits((jaccard.bit_sketch(a) ^ jaccard.bit_sketch(b)).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def labelled(spark, n=600):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        w = words(rng.randrange(5, 60), i) + (["idiot", "trash"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    return rows, marks


def test_toxicity_on_held_out(spark):
    rows, marks = labelled(spark)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    docs = table(spark, [*rows, (10**7, None), (10**7, "")])
    model = toxicity.fit(docs, toxicity.train_labels(labels))
    assert 0 < len(model[0]) < 5000
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    bad, held = dict(marks), {r.doc_id for r in toxicity.train_labels(labels).collect()}
    judged = [(r.score >= toxicity.THRESHOLD, bad[r.doc_id]) for r in got if r.doc_id in bad and r.doc_id not in held]
    assert len(judged) > 80 and sum(p == b for p, b in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + 2


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, [(1, "a")]), none)
    assert [r.score < toxicity.THRESHOLD for r in toxicity.score(table(spark, [(1, "a"), (2, None)]), model, ["doc_id"]).collect()] == [True, True]


def test_toxicity_holds_its_examples_in_little_memory():
    rng = np.random.default_rng(3)
    ats = [np.flatnonzero(rng.random(1 << 20) < 0.1) for _ in range(60)]
    for at in [*ats[:2], np.arange(1 << 20), np.empty(0, np.int64), np.array([65535, 65536, (1 << 20) - 1])]:
        assert np.array_equal(toxicity.unpacked(*toxicity.packed(at)), at)
    tracemalloc.start()
    toxicity.train((at, i % 2) for i, at in enumerate(ats))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * 8 * 2**20 + 2.5 * sum(map(len, ats)) + 2**24  # the optimiser's numbers, two bytes a feature, and one example's


def test_idle_workers_drop_their_caches(spark):
    def hold(batches):
        for (ids,) in batches:
            yield {"n": [len(worker_cache("test_text", "big", lambda: bytes(1 << 20)))] * len(ids)}

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sys.__dict__.get("_tidemark_held", {}))] * b.num_rows, pa.int64())], ["n"])

    rows = spark.range(8, numPartitions=4)
    assert {r.n for r in map_arrow(rows, hold, "n long").collect()} == {1 << 20}
    time.sleep(3)
    assert {r.n for r in rows.mapInArrow(look, "n long").collect()} == {0}


def test_lm_scores(spark):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(8)
    tongues = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randrange(1, 120)))) for i in range(300)] + [(900, None), (901, ""), (902, "É  Unseen\tX" + "y" * 200), (901, "")]
    docs = table(spark, rows)
    learn = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    got = lm.score_texts(docs, table(spark, learn)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)) + ["\n"]
    c = Counter(w for _, t in learn for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_is_the_same_however_partitioned(spark, monkeypatch):
    monkeypatch.setattr(lm, "LOT", 3000)
    docs = table(spark, [(i, " ".join(words(60, i, 50))) for i in range(150)])
    one, many = [{r.doc_id: r.score for r in lm.score_texts(d, d.where("doc_id % 5 <> 1")).collect()} for d in (docs.coalesce(1), docs.repartition(9))]
    assert one == pytest.approx(many, rel=1e-5)


def test_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 5)
    counts = spark.createDataFrame([("a", 5000), ("b", 4990), ("c", 7), ("d", 7), ("e", 3), ("f", 3), ("g", 1)], "word string, c long")
    assert [r.word for r in lm._most_frequent(counts)] == ["a", "b", "c", "d"]


def test_lm_is_normalised():
    import numpy as np

    rng = np.random.default_rng(1)
    s = lm.Scorer(*(rng.normal(0, 1, (20, 4)).astype(np.float32) for _ in range(3)), rng.normal(0, 1, 20).astype(np.float32))
    for a, b in ((0, 1), (5, 5), (19, 3)):
        assert sum(10 ** s.score(np.array([w]), np.array([a]), np.array([b]))[0] for w in range(20)) == pytest.approx(1, abs=1e-5)


def test_lm_learns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([f"{'abc'[i % 3]}{k}" for k in range(40)]) for _ in range(300))) for i in range(900)]
    got = lm.score_texts(table(spark, rows), table(spark, rows)).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
