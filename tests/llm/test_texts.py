"""p8-p10 on small cases against brute force."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import leaks, packing, subjects
from locusframe.llm.texwords import expand_macros, plain_words, readings

random.seed(11)
WORDS = ["".join(random.choice("bcdfgklmnprstvz") + random.choice("aeiou") for _ in range(3)) for _ in range(4000)]


def words(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize(
    "source,want",
    [
        (r"The \emph{old} {\it house}~stands\footnote{a note}.", "the old house standsa note"),
        (r"na\"{\i}ve caf\'e \ss{} \c{c}a M\"uller", "naive cafe ss ca muller"),
        (r"word\cite[p.~3]{key2000} next\label{sec:x} one\index{entry}", "word next one"),
        ("hyphen-\n  ated well-known", "hyphenated well known"),
        ("\\begin{quote}\nquoted ``words''\n\\end{quote}", "quoted words"),
        ("ﬁne “quotes” don’t naïve", "fine quotes dont naive"),
        ("thin\\,space hy\\-phen \\\\ line", "thin space hyphen line"),
        ("prÃ¤zise cafÃ©", "prazise cafe"),
        ("", ""),
    ],
)
def test_plain_words(source, want):
    assert " ".join(plain_words(source)) == want


def test_macros_stand_for_their_text():
    src = r"\newcommand{\who}{Nixwol}\def\verb{carried}\newcommand{\say}[2][so]{#1 #2}\let\alias\who Then \who{} \verb{} it, \say{much}, \say[too]{little}, \alias."
    assert plain_words(expand_macros(src)) == "then nixwol carried it so much too little nixwol".split()
    assert expand_macros(r"\def\x{\x\x}\x a") .endswith(" a")
    assert expand_macros(r"\def\a{p \b q}\def\b{r \a s}\a").split() == ["p", "r", r"\a", "s", "q"]
    assert expand_macros(r"\newcommand{\e}[2][D]{<#1|#2>}\e{\e[x]{in}}") == "<D|<x|in>>"


def test_macros_of_many_levels():
    names = ["m" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)]
    chain = "".join(f"\\newcommand{{\\{a}}}{{\\{b}}}" for a, b in zip(names, names[1:])) + f"\\newcommand{{\\{names[-1]}}}{{deep}}"
    assert expand_macros(chain + f"x \\{names[0]} y") == "x deep y"
    # doubled at each of many levels: left as it is instead of filling the memory
    laugh = "".join(f"\\def\\{a}{{\\{b}\\{b}}}" for a, b in zip(names[:60], names[1:])) + f"\\def\\{names[60]}{{ha}}"
    assert len(expand_macros(laugh + f"\\{names[0]} end")) < 3_000_000


def test_macros_of_a_long_text():
    src = r"\newcommand{\who}{Nixwol \did{}}\newcommand{\did}{carried}" + "a " * 2_100_000 + r"\who{} it"
    assert plain_words(expand_macros(src))[-3:] == ["nixwol", "carried", "it"]


def test_readings_with_comments():
    shown, source = readings("one two % aside\nthree\n% four five\nsix 10\\% seven\n")
    assert shown == "one two three six 10 seven".split() and source == "one two aside three four five six 10 seven".split()
    assert readings(None) == [] == readings("  \n")


def test_alignment_against_a_plain_table():
    for _ in range(40):
        a, b = np.random.randint(0, 4, 12), np.random.randint(0, 4, 9)
        h = np.zeros((10, 13), int)
        best, at = 0, (-1, -1)
        for i in range(1, 10):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if b[i - 1] == a[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                if h[i, j] > best:
                    best, at = h[i, j], (j - 1, i - 1)
        run = max((k for k in range(1, 10) for x in range(len(a) - k + 1) for y in range(len(b) - k + 1) if (a[x : x + k] == b[y : y + k]).all()), default=0)
        assert leaks.align(a.astype(np.int32), b.astype(np.int32)) == (best, run, *at)


def longest_run(a, b):
    best = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        best = max(best, k)
    return best


def test_leaks_against_brute_force(spark):
    items = [(i, "t", words(random.randint(13, 40))) for i in range(12)] + [(90, "t", None), (91, "t", ""), (92, "t", "too short"), (0, "t", None)]
    docs = []
    for d in range(60):
        parts = [words(30)]
        for _ in range(random.randint(0, 2)):
            text = items[random.randrange(12)][2].split()
            n = random.choice([5, 12, 13, 14, len(text)])
            at = random.randint(0, max(0, len(text) - n))
            piece = text[at : at + n]
            if random.random() < 0.5:
                piece = [random.choice([w, w.upper(), rf"\emph{{{w}}}", w + r"\cite{x}", w[:2] + "-\n" + w[2:]]) for w in piece]
            joined = " ".join(piece)
            parts += [random.choice([joined, "\n% " + joined.replace("-\n", "") + "\n"]), words(20)]
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, words(60_000) + " " + items[3][2]), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, -1) for d, t in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items[:-1], "item_id bigint, task string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it).filter("run >= 13").collect()}
    want = set()
    for d, t in docs[:62]:
        for i, _, x in items[:12]:
            if any(longest_run(plain_words(x), w) >= 13 for w in readings(t)):
                want.add((d, i))
    assert got == want | {(102, 3)} and len(want) > 20
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0


def test_copies_with_an_edit_every_six_words(spark, tmp_path):
    from locusframe.llm import queries

    items = [(i, words(48)) for i in range(6)]
    edit = lambda t: " ".join(f"edit{k}" if k % 6 == 5 else w for k, w in enumerate(t.split()))
    docs = [(i, f"{words(30)} {edit(t)} {words(30)}") for i, t in items] + [(50, words(90))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.p9_edited(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i, _ in items}


def test_recall_on_edited_and_partial_copies(spark, tmp_path):
    from locusframe.llm import queries

    r = random.Random(11)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(50, 90)))) for i in range(40)]

    def copy(text, every):  # a substitution, an insertion or a deletion in every ``every`` words
        out = []
        for k, w in enumerate(text.split()):
            kind = r.choice(["put", "add", "drop"]) if k % every == every - 1 else "keep"
            out += {"put": ["edit"], "add": [w, "edit", "more"], "drop": [], "keep": [w]}[kind]
        return " ".join(out)

    docs, want = [], set()
    for d, (i, text) in enumerate(items * 2):
        part = text.split()
        part = " ".join(part[10:42]) if d % 3 == 0 else text  # 32 of 50 to 90 words, or all
        docs.append((d, f"{words(80)} {copy(part, 6 + d % 3)} {words(80)}"))
        want.add((d, i))
    docs += [(1000 + k, words(300)) for k in range(40)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["doc_id"], x["item_id"]) for x in queries.p9_edited(spark, str(tmp_path)).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in enumerate(hist) if n and x)


def test_bucket_bounds_are_optimal():
    for seed in range(12):
        r = np.random.default_rng(seed)
        hist = r.integers(0, 5, 14) * r.integers(0, 2, 14)
        hist[0] = 0
        at = [int(x) for x in np.flatnonzero(hist)]
        for k in (1, 2, 3):
            if len(at) <= k:
                continue
            best = min(padding(hist, c) for c in itertools.combinations(at, k) if c[-1] == at[-1])
            bounds = packing.bucket_bounds(hist, k)
            assert len(bounds) <= k and padding(hist, bounds) == best


@pytest.mark.parametrize("capacity,buckets", [(20, 4), (64, 128), (1, 3)])
def test_packing_holds_every_token_once(spark, capacity, buckets):
    r = random.Random(capacity)
    lengths = [(i, r.choice([0, 1, r.randint(1, 30), r.randint(1, 200)])) for i in range(300)] + [(999, None)]
    out = packing.pack(spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint"), capacity, buckets, rows_per_block=7).collect()
    room, places = {}, set()
    for p in out:
        room[p["container_id"]] = room.get(p["container_id"], 0) + p["n_tokens"]
        places.add((p["container_id"], p["slot"]))
        assert p["token_start"] == p["piece"] * capacity
    assert max(room.values()) <= capacity and len(places) == len(out) and set(room) == set(range(len(room)))
    held = {}
    for p in out:
        held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["n_tokens"]
    assert held == {i: n for i, n in lengths if n}
    assert all(sum(q["doc_id"] == i for q in out) == -(-n // capacity) for i, n in lengths if n)
    # first-fit decreasing over exact lengths is a good packing; ours may not be much worse
    boxes = []
    for n in sorted((q["n_tokens"] for q in out), reverse=True):
        k = next((k for k, x in enumerate(boxes) if x + n <= capacity), None)
        boxes = boxes + [n] if k is None else boxes[:k] + [boxes[k] + n] + boxes[k + 1 :]
    assert len(room) <= len(boxes) * 1.1 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), capacity, buckets).count() == 0
    inside = packing.pack(spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint"), capacity, buckets, combine=False).collect()
    assert sum(p["n_tokens"] for p in inside) == sum(n for _, n in lengths if n)
    boxes = {}
    for p in inside:
        boxes.setdefault(p["container_id"], []).append(p["bucket"])
    assert all(len(set(b)) == 1 and sum(b) <= capacity for b in boxes.values())


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary file")
def test_token_counts_match_another_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["Hello  world\n\n", "naïve café — ß", "<|endoftext|>", "x" * 5000, " " * 300 + "y", "", None]
    got = dict(packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).rdd.map(tuple).collect())
    assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(texts)}
    count = packing.counter()
    assert count(" " * 400_000 + "y") > 0


def article(*sections):
    return "\\begin{document}" + "".join(f"\\section{{S}}\n{s}\n% the court judge statute verdict plaintiff\n" for s in sections) + "\\end{document}"


def test_subjects(spark):
    r = random.Random(3)
    lex = {s: [w for w in t.split() if len(w) > 3][:12] for s, t in subjects.TERMS.items()}
    say = lambda s: "The " + ". We study the ".join(" of ".join(r.sample(lex[s], 3)) for _ in range(6)) + " and this is that."
    docs, want = [], set()
    for i in range(160):
        a, b = r.sample(sorted(lex), 2)
        n = r.choice([0, 0, 1, 2])
        parts = [say(a) for _ in range(5 - n)] + [say(b) for _ in range(n)]
        docs.append((i, article(*parts), b))
        want |= {(i, a)} | ({(i, b)} if n >= 2 else set())
    docs += [(900, None, ""), (901, "", ""), (902, "\\documentclass{article}\\begin{document}\\input{body}\\end{document}", ""), (903, "word " * 3, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    got = {(x["doc_id"], x["subject"]) for x in subjects.document_subjects(df).collect()}
    assert len(got ^ want) <= 0.05 * len(want)
    assert {x["lang"] for x in subjects.document_subjects(df).collect()} == {"en"}
    labels = spark.createDataFrame([*want, (901, "law"), (None, "law"), (3, None)], "doc_id bigint, subject string")
    found = spark.createDataFrame([(i, "en", s) for i, s in got], "doc_id bigint, lang string, subject string")
    a = {x["lang"]: x for x in subjects.agreement(found, labels).collect()}
    assert a["en"]["hits"] == len(got & want) and a["en"]["labels"] + a[None]["labels"] == len(want) + 1
    assert subjects.document_subjects(df.limit(0)).count() == 0


def test_a_text_without_function_words_is_of_no_language():
    assert subjects._split("\\section{A}" + "xyzzy " * 30)[0] == "other"
    assert subjects._split("\\section{A} der die das und")[0] == "de"
    assert subjects._words("Na\u00efve caf\u00e9-Bar x2y ABC") == ["naive", "cafe", "bar", "abc"]


def test_digamma_and_inference_against_plain_loops():
    assert np.allclose(subjects.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-9)
    rng = np.random.default_rng(1)
    beta = rng.random((40, 5)).astype(np.float32)
    bags = [[(int(i), int(rng.integers(1, 4))) for i in rng.choice(40, size, replace=False)] for size in (3, 0, 40, 7, 1, 12)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    ids, n = (np.array([x[k] for b in bags for x in b], np.int64) for k in (0, 1))
    sums = np.zeros((40, 5))
    got = subjects.infer(offsets, ids, n, beta, sums)
    for row, bag in zip(got, bags):
        theta, taken = np.full(5, 0.2), np.zeros(5)
        for _ in range(subjects.ROUNDS):
            taken = sum((c * theta * beta[i] / (theta @ beta[i]) for i, c in bag), np.zeros(5))
            theta = np.exp(subjects.digamma(subjects.ALPHA + taken))
            theta /= theta.max()
        assert np.allclose(row, taken, rtol=1e-3, atol=1e-4)
    assert np.allclose(sums.sum(axis=1), np.bincount(ids, weights=n, minlength=40), rtol=1e-4)


@pytest.mark.parametrize("docs", [20, 400])
def test_every_section_counts_once_in_the_fit(spark, docs):
    r = random.Random(5)
    texts = [(i, article(*[" ".join(r.sample(WORDS[:400], 30)) + f" the and of is {w}" for w in r.sample(WORDS[:400], 3)])) for i in range(docs)]
    rows = subjects.sections(spark.createDataFrame(texts, "doc_id bigint, text string"))
    vocabularies, size = subjects._vocabularies(rows)
    assert size == {"en": 3 * docs}
    assert rows.filter("section >= 0").count() == 3 * docs
    kept = rows.filter("section >= 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(subjects.PARTS)).cast("int"))
    bags = kept.mapInPandas(subjects._bag_batches(vocabularies), "doc_id bigint, lang string, section int, part int, ids array<int>, n array<int>").cache()
    want = np.zeros(len(vocabularies["en"]))
    for b in bags.collect():
        np.add.at(want, b["ids"], b["n"])
    weights = subjects.fit_topics(bags, vocabularies, size, 8)["en"] - subjects.ETA
    assert np.allclose(weights.sum(axis=1), want, rtol=1e-3)
