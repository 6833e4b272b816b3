"""Filling fixed-capacity containers with texts of varying length.

Lengths in tokens are reduced to one global histogram of at most ``capacity`` entries.
Dynamic programming over it chooses the bucket boundaries that minimise padding, and
containers are token-budget batches of the buckets' members:

* a *pattern* says how many members of which buckets one container takes.  Patterns are
  made on the driver from the bucket sizes alone: the largest bucket left, then the
  fullest budget that dynamic programming (subset sums) finds in the rest, repeated as
  often as the buckets allow.  Members of one bucket are interchangeable, so this needs
  neither the rows nor their number;
* every member gets its rank inside its bucket, from block counts and a row number within
  small hash blocks, and reads its container off the patterns.

Batches confined to one bucket (``combine=False``) leave a third of each container empty
where texts are about half a container long, so patterns combine buckets by default; the
bucket is what is interchangeable, not what is batched.  An item is cut only if it exceeds
the capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the texts of this vocabulary are parted before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 128
#: Members of a bucket that one task ranks, about.
ROWS_PER_BLOCK = 100_000


def counter(tokenizer: str = TOKENIZER, pattern: str = PATTERN):
    """A function from a text to its number of tokens; the vocabulary is a file of base64
    tokens and their ranks.  What the encoder's pattern matcher gives up on (such as very long runs of
    white space) is parted by another one, with the same result."""
    import base64

    import regex
    import tiktoken

    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    parts = regex.compile(pattern)

    def count(text: str | None) -> int:
        if not isinstance(text, str) or not text:
            return 0
        try:
            return len(encoding.encode_ordinary(text))
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a panic of the matcher is no Exception
            return sum(len(encoding._encode_single_piece(p)) for p in parts.findall(text))

    return count


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count(x) for x in pdf["text"]]})

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id bigint, n_tokens bigint")


def bucket_bounds(histogram: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets that minimise the total padding, where
    ``histogram[l]`` items have length l (l >= 1) and each is padded to its bound.
    Exact: dynamic programming over the lengths that occur."""
    at = np.flatnonzero(histogram)
    at = at[at > 0]
    if len(at) <= k:
        return [int(x) for x in at]
    n = histogram[at].astype(np.float64)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * at)])
    m = len(at)
    # cost[i, j]: padding of lengths i..j in one bucket bounded by at[j]
    i, j = np.arange(m)[:, None], np.arange(m)[None, :]
    cost = at[j] * (count[j + 1] - count[i]) - (total[j + 1] - total[i])
    cost[i > j] = np.inf
    best = cost[0].copy()
    cuts = []
    for _ in range(1, k):
        through = best[:-1, None] + cost[1:, :]  # last bucket starts at i + 1
        frm = through.argmin(axis=0)
        new = through[frm, np.arange(m)]
        frm[new >= best] = -1
        cuts.append(frm)
        best = np.minimum(best, new)
    bounds, j = [], m - 1
    for frm in reversed(cuts):
        if frm[j] >= 0:
            bounds.append(int(at[j]))
            j = int(frm[j])
    bounds.append(int(at[j]))
    return sorted(set(bounds))


def _fill(budget: int, sizes: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """The members (bucket -> number) that fill most of ``budget``; of equal fills the
    one of larger members."""
    reached = np.full(budget + 1, -1, np.int32)  # by which bucket a sum was last reached
    reached[0] = len(sizes)
    before = np.zeros(budget + 1, np.int32)
    for b in range(len(sizes) - 1, -1, -1):
        s = int(sizes[b])
        if s > budget or not left[b]:
            continue
        for _ in range(int(min(left[b], budget // s))):
            new = (reached[s:] < 0) & (reached[: budget + 1 - s] >= 0)
            if not new.any():
                break
            to = np.flatnonzero(new) + s
            reached[to] = b
            before[to] = to - s
        if reached[budget] >= 0:
            break
    r = int(np.flatnonzero(reached >= 0)[-1])
    used: dict[int, int] = {}
    while r:
        b = int(reached[r])
        used[b] = used.get(b, 0) + 1
        r = int(before[r])
    return used


def plan_patterns(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {bucket: members}) that use up all members; each step empties a bucket or
    leaves fewer members than the step took, so the plan stays of the order of the
    number of buckets, whatever the counts."""
    sizes, left = np.array(bounds, np.int64), np.array(counts, np.int64)
    plan = []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        used = _fill(int(capacity - sizes[top]), sizes, left)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = int(min(left[b] // n for b, n in used.items()))
        for b, n in used.items():
            left[b] -= times * n
        plan.append((times, used))
    return plan


def plan_buckets(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """As :func:`plan_patterns`, with token-budget batches inside each bucket only."""
    plan = []
    for b, (bound, n) in enumerate(zip(bounds, counts)):
        times, rest = divmod(n, capacity // bound)
        plan += [(times, {b: capacity // bound})] * (times > 0) + [(1, {b: rest})] * (rest > 0)
    return plan


def pack(lengths: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, combine: bool = True, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, bucket, container_id, slot) from
    (doc_id, n_tokens): every token of every text in exactly one container.

    No container holds more than ``capacity`` tokens.  Texts up to the capacity have one
    piece; longer ones are cut into full pieces and a rest.  Texts of null or no length
    are in no container.  Rows of the same doc_id are told apart by nothing and may only
    occur once.  ``bucket`` is the bound the piece's length is counted with.  ``combine``:
    containers take members of several buckets; else of one.
    """
    spark = lengths.sparkSession
    whole = lengths.filter("n_tokens > 0")
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = whole.select("doc_id", F.posexplode(F.sequence(F.lit(0), last)).alias("piece", "_p"), "n_tokens")
    start = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("n_tokens"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[r["n_tokens"]] = r["n"]
    bounds = bucket_bounds(histogram, buckets)
    which = np.searchsorted(bounds, np.arange(capacity + 1))
    counts = [int(histogram[which == b].sum() - (histogram[0] if b == 0 else 0)) for b in range(len(bounds))]
    plan = (plan_patterns if combine else plan_buckets)(bounds, counts, capacity)

    # per bucket: from which rank on which pattern holds its members
    segments: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in range(len(bounds))}
    taken, container = [0] * len(bounds), 0
    for times, used in plan:
        slot = 0
        for b in sorted(used, reverse=True):
            segments[b].append((taken[b], container, used[b], slot))
            taken[b] += times * used[b]
            slot += used[b]
        container += times
    table = {b: tuple(np.array(c, np.int64) for c in zip(*s)) for b, s in segments.items() if s}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "piece", "token_start", "n_tokens"]].copy()
            where, slots = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int32)
            b_all, rank = pdf["b"].to_numpy(), pdf["rank"].to_numpy()
            for b in np.unique(b_all):
                mine = np.flatnonzero(b_all == b)
                first, box, per, slot = table[int(b)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                past = rank[mine] - first[k]
                where[mine] = box[k] + past // per[k]
                slots[mine] = slot[k] + past % per[k]
            out["bucket"] = np.array(bounds, np.int32)[b_all]
            out["container_id"], out["slot"] = where, slots
            yield out

    schema = "doc_id bigint, piece int, token_start bigint, n_tokens int, bucket int, container_id bigint, slot int"
    if not bounds:
        return spark.createDataFrame([], schema)
    lookup = F.array(*[F.lit(int(x)) for x in which])
    blocks = F.array(*[F.lit(max(1, -(-n // rows_per_block))) for n in counts])
    keyed = pieces.withColumn("b", F.get(lookup, F.col("n_tokens")))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.get(blocks, F.col("b"))).cast("int"))
    sizes = keyed.groupBy("b", "block").agg(F.count(F.lit(1)).alias("n"))  # at most buckets + pieces / rows_per_block rows
    before = F.sum("n").over(Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(sizes.select("b", "block", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    row = F.row_number().over(Window.partitionBy("b", "block").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("row", row).join(F.broadcast(offsets), ["b", "block"]).withColumn("rank", F.col("row") - 1 + F.col("before"))
    return ranked.select("doc_id", "piece", "token_start", "n_tokens", "b", "rank").mapInPandas(place, schema)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, combine: bool = True) -> DataFrame:
    """:func:`pack` over the token counts of whole texts, which are written once."""
    return pack(cut(token_counts(documents, tokenizer=tokenizer), "token-counts"), capacity, buckets, combine)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, fullest container and the share left over."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).withColumn("left_over", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))
