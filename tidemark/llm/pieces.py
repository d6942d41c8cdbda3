"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which lays them out as a trie in
depth-first order, and each word starts from the forward scores of the prefix it
shares with the one before. The model is a merge model, so a path's score is not a
sum over pieces: the score of a piece after another is whether the two, joined and
merged anew, come out as the same two. Merging never crosses a final boundary, so a
sequence is the model's own exactly if all neighbours pass, and at every position
one piece survives. The forward pass therefore keeps a single state a position, is
linear in the word and gives the library's ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, table, worker_cache
from tidemark.llm.tokens import MARK, can_split, model_path

#: Distinct words, and pairs of neighbouring pieces, that a worker remembers; longer words are not kept.
HELD, HELD_PAIRS, HELD_CHARS = 1 << 18, 1 << 19, 48
#: Words and the runs between them that stand alone: a line end is no piece, so no merge crosses it.
WORD = re.compile(" *[^ \n]+| +|\n")


class Codec:
    """Ids of texts and back, from the piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        try:
            with open(path, "rb") as f:
                model.ParseFromString(f.read())
        except OSError:
            with open(SparkFiles.get(path.rpartition("/")[2]), "rb") as f:
                model.ParseFromString(f.read())
        self.text = [p.piece.replace(MARK, " ") for p in model.pieces]
        self.ids = {t: i for i, (t, p) in enumerate(zip(self.text, model.pieces, strict=True)) if p.type == 1}
        self.score = {t: model.pieces[i].score for t, i in self.ids.items()}
        raw = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = [raw[b] for b in range(256)]
        back = {i: bytes([b]) for b, i in raw.items()}
        shown = {i: t.encode() for t, i in self.ids.items()}
        self.out = [back.get(i, shown.get(i, b"")) for i in range(len(self.text))]
        self.longest = max(map(len, self.ids))
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, s: str) -> list[str]:
        """Merging as defined: the best-scored neighbours first, the leftmost among equals."""
        parts, score = list(s), self.score.get
        marks = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, m in enumerate(marks):
                if m is not None and (best is None or m > best):
                    best, at = m, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del marks[at]
            if at:
                marks[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(marks):
                marks[at] = score(parts[at] + parts[at + 1])

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a; a below 0 is a start or a character that is no piece."""
        if a < 0:
            if (ok := self.whole.get(b)) is None:
                ok = self.whole[b] = len(self.merged(self.text[b])) == 1
            return ok
        key = a << 32 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return ok

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of distinct words, in the order of their trie."""
        get, follows, longest = self.ids.get, self.follows, self.longest
        state, size = [-1], [0]  # by position: the piece that ends there, and its length
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del state[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for n in range(min(i, longest), 0, -1):
                    piece = get(word[i - n : i])
                    if piece is not None and follows(state[i - n], piece):
                        state.append(piece)
                        size.append(n)
                        break
                else:
                    state.append(-1)
                    size.append(1)
            back, i = [], len(word)
            while i:
                if state[i] >= 0:
                    back.append(state[i])
                else:
                    back.extend(self.byte[b] for b in reversed(word[i - 1].encode()))
                i -= size[i]
            yield word, tuple(reversed(back))
            before = word

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts. Null and empty texts have none."""
        split = [WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        held = self.words
        missing = {w for ws in split for w in ws if w not in held}
        if len(held) + len(missing) > HELD:
            held.clear()
            missing = {w for ws in split for w in ws}
        new = dict(self.encode_words(list(missing)))
        held.update(new)
        out = [list(chain.from_iterable(map(held.__getitem__, ws))) for ws in split]
        for w in new:
            if len(w) > HELD_CHARS:
                del held[w]
        if len(held) > HELD:
            held.clear()
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; control pieces have none, and bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids or ())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    return worker_cache("pieces", path, lambda: Codec(path))


#: Characters of texts that are encoded together.
TOGETHER = 1 << 19


def _groups(texts: list[str | None]) -> Iterator[slice]:
    lo = total = 0
    for hi, t in enumerate(texts):
        total += len(t or "")
        if total >= TOGETHER:
            yield slice(lo, hi + 1)
            lo, total = hi + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _prepare(df: DataFrame, path: str) -> None:
    assert can_split(path), "this model's merges can cross the marked words"
    df.sparkSession.sparkContext.addFile(path)


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>), one row for each; null texts have no ids."""
    _prepare(docs, path)

    def run(batches) -> Iterator[dict]:
        model = codec(path)
        for keys, texts in batches:
            for g in _groups(texts):
                yield {"doc_id": keys[g], "ids": model.encode(texts[g])}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {_kind(docs)}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give an empty text."""
    _prepare(encoded, path)

    def run(batches) -> Iterator[dict]:
        model = codec(path)
        for keys, ids in batches:
            yield {"doc_id": keys, "text": [model.decode(x) for x in ids]}

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {_kind(encoded)}, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, restored) and perhaps ids: encodes and decodes every whole text.

    ids_sha256 is over the ids as little-endian 32-bit integers; restored says that
    decoding gives the text back, in which the model's mark counts as a space.
    """
    _prepare(docs, path)

    def run(batches) -> Iterator[dict]:
        model = codec(path)
        for keys, texts in batches:
            for g in _groups(texts):
                ids = model.encode(texts[g])
                yield {
                    "doc_id": keys[g],
                    "ids": ids,
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(np.asarray(x, "<i4").tobytes()).hexdigest() for x in ids],
                    "restored": [model.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts[g], strict=True)],
                }

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, restored boolean" + ", ids array<int>" * with_ids)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes every document, digests the ids and checks that they decode to the text."""
    return round_trip(table(spark, sf_dir, "documents"), model_path())
