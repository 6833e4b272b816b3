"""Evaluation texts leaking into training text.

Rare n-gram seeds join documents to test items; Smith-Waterman alignment over words then
scores exact, edited and paraphrased copies.

1. Every item becomes words and overlapping n-grams.  A Bloom filter of BITS_A_GRAM bits a
   gram and at most MOST_BITS goes to all tasks; a fuller filter lets more through, which
   the join with the seeds sorts out.
2. One pass over the documents normalises each whole text and keeps those with an n-gram
   the filter knows.  Nothing else of the corpus is shuffled.
3. Corpus frequencies of the n-grams found choose the seeds: in every run of ``window``
   item words the rarest n-gram.  A passage shared over ``window`` words holds the seed
   of that run, so the choice loses nothing; a run with an n-gram that occurs nowhere
   has no copy and needs no seed.
4. Documents and items that share a seed are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.texwords import plain_words, readings
from locusframe.operators.skew import salted_join
from locusframe.session import cut

GRAM = 5
WINDOW = 13
BITS_A_GRAM = 256
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: A gram sets two bits: one by its lowest digits, one by those from here on.
_SECOND = 33
#: Item words that the alignment of an edited copy must span, and the share of the best
#: score of such a stretch that it must reach: at most an edit in every five words.
LEAST_STRETCH = 20
LEAST_SCORE = 0.7
#: Words after which a task hashes what it holds.
WORDS_AT_ONCE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a word sequence given by word hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out * _MIX) ^ hashes[k : k + m]
        out ^= out >> np.uint64(29)
    return out


def _hash_words(lists: list[list[str]]) -> list[np.ndarray]:
    """Word hashes of several texts; every distinct word of the batch is hashed once."""
    flat = [w for words in lists for w in words]
    if not flat:
        return [np.empty(0, np.uint64) for _ in lists]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
    return np.split(hashed, np.cumsum([len(x) for x in lists])[:-1])


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, grams): items as words and hashes of their n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [plain_words(t) if isinstance(t, str) else [] for t in pdf["text"]]
            grams = [_gram_hashes(h, GRAM).view(np.int64) for h in _hash_words(words)]
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [" ".join(w) for w in words], "grams": grams})

    return items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).mapInPandas(run, "item_id bigint, words string, grams array<bigint>")


def _bloom(grams: DataFrame) -> np.ndarray:
    """The n-grams as a bit set; what comes to the driver is at most MOST_BITS / 64 words
    (128 MB), however many items there are."""
    n = grams.count()
    bits = 1 << min(max((BITS_A_GRAM * n).bit_length(), LEAST_BITS.bit_length() - 1), MOST_BITS.bit_length() - 1)
    at = F.col("at")
    words = grams.select(F.explode(F.array(F.pmod("h", F.lit(bits).cast("bigint")), F.pmod(F.shiftrightunsigned("h", _SECOND), F.lit(bits).cast("bigint")))).alias("at"))
    words = words.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("b"))
    words = words.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["i"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)


def _scan(bits: np.ndarray):
    def found(ids: list[int], nos: list[int], lists: list[list[str]]) -> pd.DataFrame:
        rows = []
        for doc_id, no, words, hashes in zip(ids, nos, lists, _hash_words(lists)):
            grams = _gram_hashes(hashes, GRAM)
            known = np.flatnonzero(_has(bits, grams) & _has(bits, grams >> np.uint64(_SECOND)))
            if len(known):
                rows.append((doc_id, no, " ".join(words), known.astype(np.int32), grams[known].view(np.int64)))
        return pd.DataFrame(rows, columns=["doc_id", "reading", "words", "places", "hashes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nos, lists, n = [], [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for no, words in enumerate(readings(text if isinstance(text, str) else None)):
                    ids.append(doc_id)
                    nos.append(no)
                    lists.append(words)
                    n += len(words)
                if n > WORDS_AT_ONCE:  # word lists are large: never those of a whole batch
                    yield found(ids, nos, lists)
                    ids, nos, lists, n = [], [], [], 0
            yield found(ids, nos, lists)

    return run


def align(doc: np.ndarray, item: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """(score, run, last_doc, last_item): the best local alignment score of two word
    sequences, the length of their longest common run of words, and the places where the
    best alignment ends (the first of several).  Smith-Waterman with linear gaps; a row of
    the table is one vector, its horizontal gaps a running maximum."""
    n = len(doc)
    ramp = np.arange(n, dtype=np.int32) * -gap
    above = np.zeros(n + 1, np.int32)
    runs = np.zeros(n + 1, np.int32)
    score = longest = 0
    last_doc = last_item = -1
    for i, w in enumerate(item):
        same = doc == w
        row = np.maximum(above[:-1] + np.where(same, match, mismatch), above[1:] + gap)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        above[1:] = row
        runs[1:] = np.where(same, runs[:-1] + 1, 0)
        best = int(row.argmax()) if n else 0
        if n and row[best] > score:
            score, last_doc, last_item = int(row[best]), best, i
        longest = max(longest, int(runs.max()))
    return score, longest, last_doc, last_item


def _verify(edited: bool):
    # From its first seed back, and from its last on, an alignment worth its while has no
    # more words than the item, and gaps for two points a word.  An unedited run is nearer.
    reach = 3 if edited else 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, item_id, words, item, first, last in pdf[["doc_id", "item_id", "words", "item", "first", "last"]].itertuples(index=False):
                item = item.split()
                words = words.split()[max(0, first - reach * len(item)) : last + reach * len(item) + GRAM]
                codes: dict[str, int] = {}
                a = np.array([codes.setdefault(w, len(codes)) for w in item], np.int32)
                b = np.array([codes.get(w, -1) for w in words], np.int32)
                score, longest, last_doc, last_item = align(b, a)
                # the same alignment from its end says where it begins
                stretch = align(b[last_doc::-1], a[last_item::-1])[3] + 1 if edited and score else None
                rows.append((doc_id, item_id, score, longest, len(item), stretch))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "run", "item_words", "stretch"]).astype({"stretch": "Int32"})

    return run


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, run, item_words, stretch) of every document and item that
    share a seed: alignment score (2 a matched word, -1 an edit), longest common run in
    words, the item's words and, with ``edited``, how many of them the best alignment spans.

    Complete for copies of ``window`` or more consecutive words.  With ``edited`` the seed
    of a run is its rarest n-gram that occurs, so that a copy edited in every run still
    has seeds where GRAM words stand together.  Items of fewer than GRAM words have no
    seed and match nothing; null, empty and word-less texts, on either side, hold nothing;
    repeated rows give one result; an empty table gives an empty result.  Whole texts are
    read, however long.  Other columns of either table are not read.
    """
    words = cut(item_words(items, item_id, text), "item-words")
    grams = words.select("item_id", F.posexplode("grams").alias("place", "h"))
    bits = documents.sparkSession.sparkContext.broadcast(_bloom(grams)).value
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    hits = cut(docs.mapInPandas(_scan(bits), "doc_id bigint, reading int, words string, places array<int>, hashes array<bigint>"), "hits")
    flat = hits.select("doc_id", "reading", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("doc_id", "reading", F.col("x.places").alias("place"), F.col("x.hashes").alias("h"))
    df = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(df, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    run = Window.partitionBy("item_id").orderBy("place").rowsBetween(0, window - GRAM)
    seed = F.when(F.col("df") > 0, F.struct("df", "h")) if edited else F.struct("df", "h")
    rarest = ranked.withColumn("s", F.min(seed).over(run)).withColumn("full", F.count(F.lit(1)).over(run))
    # only whole windows; an item that is shorter than one is a window itself
    rarest = rarest.filter((F.col("s.df") > 0) & ((F.col("full") == window - GRAM + 1) | (F.col("place") == 0)))
    seeds = cut(rarest.select("item_id", F.col("s.h").alias("h"), F.col("s.df").alias("df")).distinct(), "seeds")
    pairs = salted_join(flat, seeds, "h", "df", spread=["doc_id", "reading", "place"]).groupBy("doc_id", "reading", "item_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    pairs = pairs.join(words.select("item_id", F.col("words").alias("item")), "item_id").join(hits.select("doc_id", "reading", "words"), ["doc_id", "reading"])
    out = pairs.mapInPandas(_verify(edited), "doc_id bigint, item_id bigint, score int, run int, item_words int, stretch int")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "stretch")).alias("best"), F.max("run").alias("run"), F.max("item_words").alias("item_words"))
    return best.select("doc_id", "item_id", F.col("best.score").alias("score"), "run", "item_words", F.col("best.stretch").alias("stretch"))
