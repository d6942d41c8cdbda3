"""Token counts without token ids.

Pre-tokens are the runs that no merge of the tokenizer can cross: white space as the
model marks it plus the letters up to the next mark or line end. One relation holds
each distinct pre-token of all texts with its frequency, and its pieces are counted
there, once. It is joined to the documents' pre-token frequencies, and a document's
count is the sum of frequency times pieces. The join has two parts: the most frequent
pre-tokens, a bounded number, are broadcast and summed where the text is read; the
others are joined by a shuffle, where no pre-token has more than about a HEAD-th of
all occurrences, so none is hot. A pre-token that occurs once in all texts has no
other place to share its count with: it is left out of the joined relation, and
counted where the join finds nothing for it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, map_arrow, share, table, worker_cache

MODEL = "piece_bpe_32k.model"
#: Pre-tokens whose pieces are broadcast.
HEAD = 1 << 17
#: Distinct pre-tokens, and characters of text, that a task counts up before it hands them on.
HELD, HELD_CHARS = 1 << 18, 1 << 25
#: A pre-token of more characters is joined by its digest.
LONG = 32
#: The mark that the model writes for a space.
MARK = "▁"
#: Marked words, and white space before a line's end.
PRETOKEN = re.compile(" *[^ \n]+| +")


def load_model(path: str):
    """The model file is read where it is used: from the path, or as shipped with the job under its name."""
    import sentencepiece

    def make():
        try:
            return sentencepiece.SentencePieceProcessor(model_file=path)
        except OSError:
            return sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(path.rpartition("/")[2]))

    return worker_cache("tokens", f"model:{path}", make)


def can_split(path: str) -> bool:
    """Whether pre-tokens are safe: identity normalisation, and no piece holds a line end or a mark after a letter."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and model.trainer_spec.byte_fallback
    return plain and not any(p.type in (1, 4) and ("\n" in p.piece or re.search(f"[^{MARK}]{MARK}", p.piece)) or p.type == 4 for p in model.pieces)


def key(word: str) -> str:
    """What a pre-token is joined by; no pre-token holds a line end."""
    return word if len(word) <= LONG else "\n" + hashlib.sha256(word.encode()).hexdigest()


def frequencies(text: str) -> Counter:
    """How often each pre-token occurs in a text; line ends are not among them."""
    return Counter(PRETOKEN.findall(" " + text.replace(MARK, " ")))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, word, c): each distinct pre-token of all texts once, with its frequency, combined in the task and before the shuffle."""

    def run(batches) -> Iterator[dict]:
        held, chars = Counter(), 0
        for (texts,) in batches:
            for t in filter(None, texts):
                held.update(frequencies(t))
                chars += len(t)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield rows(held)
                    held, chars = Counter(), 0
        yield rows(held)

    def rows(held: Counter) -> dict:
        return {"key": [key(w) for w in held], "word": [w if len(w) > LONG else None for w in held], "n": list(held.values())}

    made = map_arrow(docs.select("text"), run, "key string, word string, n long")
    return made.groupBy("key", "word").agg(F.sum("n").alias("c")).withColumn("word", F.coalesce("word", "key"))


def piece_counts(path: str, words: list[str]) -> list[int]:
    """Pieces of each word."""
    model = load_model(path)
    breaks = len(model.encode("\n"))
    # The model puts a mark before a text, so a marked word goes without its first space;
    # a bare mark, and a word after a line end, go with a line end whose tokens come off again.
    marked = [w[0] == " " and len(w) > 1 for w in words]
    sent = [w[1:] if m else "\n" + w for w, m in zip(words, marked, strict=True)]
    return [len(x) - (0 if m else breaks) for m, x in zip(marked, model.encode(sent, num_threads=1), strict=True)]


def with_pieces(words: DataFrame, path: str) -> DataFrame:
    """(key, c, pieces) of distinct pre-tokens."""

    def run(batches) -> Iterator[dict]:
        for keys, texts, c in batches:
            yield {"key": keys, "c": c, "pieces": piece_counts(path, texts)}

    return map_arrow(words.select("key", "word", "c"), run, "key string, c long, pieces long")


def with_lone_pieces(rare: DataFrame, path: str) -> DataFrame:
    """(row, word, times, pieces) to (row, n), where pieces that are null, those of pre-tokens outside the relation, are counted."""

    def run(batches) -> Iterator[dict]:
        for rows, texts, times, pieces in batches:
            lone = iter(piece_counts(path, [w for w, p in zip(texts, pieces, strict=True) if p is None]))
            yield {"row": rows, "n": [t * (next(lone) if p is None else p) for t, p in zip(times, pieces, strict=True)]}

    return map_arrow(rare.select("row", "word", "times", "pieces"), run, "row long, n long")


def most_frequent(words: DataFrame, most: int) -> list[Row]:
    """(key, pieces) of the pre-tokens above the least frequency, by a histogram, that leaves no more than most."""
    step = F.floor(F.log2("c") * 64)
    total, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return words.where(step >= least).select("key", "pieces").collect() if least is not None else []


def count_tokens(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens), one row for each; null texts are empty.

    Rows are told apart by their place in the written frequencies, so repeated and null
    ids keep their rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    if not can_split(path):
        raise ValueError("this model's merges can cross the pre-tokens")
    spark.sparkContext.addFile(path)
    words = checkpointed(with_pieces(word_counts(docs).where("c > 1"), path))  # read by the histogram, the head and the tail
    held = share(spark, {r.key: r.pieces for r in most_frequent(words, head)})

    def run(batches) -> Iterator[dict]:
        known = held()
        for ids, texts in batches:
            sums, tails = [], []
            for t in texts:
                n, tail = 0, []
                if t:
                    n = t.count("\n")  # with byte fallback a line end is one token
                    for w, times in frequencies(t).items():
                        if (pieces := known.get(w if len(w) <= LONG else key(w))) is None:
                            tail.append((w, times))
                        else:
                            n += pieces * times
                sums.append(n)
                tails.append(tail)
            yield {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n": sums, "tail": tails}

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = checkpointed(map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n long, tail map<string,long>"))
    made = made.withColumn("row", F.monotonically_increasing_id())
    long = F.length("word") > LONG
    rare = made.select("row", F.explode("tail").alias("word", "times"))
    keyed = rare.select("row", "times", F.when(long, F.concat(F.lit("\n"), F.sha2("word", 256))).otherwise(F.col("word")).alias("key"), F.when(long, F.col("word")).alias("word"))
    joined = keyed.join(words.select("key", "pieces"), "key", "left").withColumn("word", F.coalesce("word", "key"))
    sums = made.select("row", "doc_id", "n_bytes", "n").unionByName(with_lone_pieces(joined, path), allowMissingColumns=True)
    return sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether it exceeds a context of 4096."""
    counted = count_tokens(table(spark, sf_dir, "documents"), model_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
