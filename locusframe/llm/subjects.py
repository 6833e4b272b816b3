"""Subject area of each document by latent Dirichlet topic models.

Documents are split into their sections (comments, commented drafts and bibliographies
left out).  For each language a topic model is fitted by distributed variational Bayes
over the bags of words of all its sections; topics are mapped to subjects by their top
terms; a section's subject is the one that its topics give most, and a document's subjects
are those of a quarter or more of its sections.

The sections are in PARTS disjoint parts, and every part updates the model EPOCHS times, at
every size: tasks infer the topics of their part's sections in Arrow batches and add up what
each topic takes of each term, and the part's sums replace those of its last turn (incremental
variational Bayes).  No step size, no sampling with replacement: when the fit ends, every
section counts once.  A model starts from centroids of START_SECTIONS sections per language,
chosen by hash; that sample only says where the fit begins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.texwords import _DOUBLE_ENCODED, _recode
from locusframe.session import cut

SUBJECTS = ("physics", "mathematics", "software", "medicine", "law", "sport", "economics", "biology")

# Words by which a text's language is told.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "is", "that", "with", "for", "this", "was", "are"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "wir", "von", "eine", "auch", "wurde", "ohne"),
    "fr": ("le", "la", "les", "des", "est", "une", "pour", "dans", "on", "et", "du", "aussi"),
}

# What inspecting top terms goes by, general terms of each subject in English,
# German and French (marks set aside).  A term may stand for one subject only.
TERMS = {
    "physics": "photon neutrino plasma quantum magnet superfluid entropy laser spectrum detector beam resonance relativistic ionised ultracold wave scattering particle teilchen magnetfeld strahlung spektrum feldstarke particule aimant rayonnement spectre champ",
    "mathematics": "theorem lemma manifold polynomial eigenvalue functor sheaf homology conjecture abelian nilpotent martingale inequality topology algebra polynom eigenwert mannigfaltigkeit funktor ungleichung ring satz anneau variete polynome foncteur faisceau inegalite",
    "software": "compiler parser cache scheduler deadlock thread database allocator refactoring asynchronous stateless memory queue software warteschlange speicher schnittstelle datenbank ubersetzer prufstand compilateur ordonnanceur tampon memoire interface donnees",
    "medicine": "patient diagnosis therapy vaccine clinical tumour biopsy dose placebo symptom radiograph infection nurse mortality patientin diagnose klinik impfstoff dosis blutdruck malade clinique vaccin diagnostic tension",
    "law": "court statute plaintiff defendant contract liability jurisdiction verdict injunction judge evidence clause statutory gericht urteil klage vertrag haftung gesetz tribunal jugement contrat recours plainte loi",
    "sport": "coach goalkeeper referee tournament champion season league stadium striker midfield sprinter marathon racket athlete torwart trainer mannschaft turnier laufer saison gardien equipe coureur entraineur tournoi",
    "economics": "inflation market tax wage household auction investment productivity fiscal price demand monetary steuer lohn nachfrage markt zinssatz haushalt salaire impot menage marche taux demande",
    "biology": "enzyme gene genome larva habitat predator ecosystem receptor mutation allele membrane bacterium species enzym gen zelle larve lebensraum cellule espece",
}

TOPICS = 24
#: Terms in more than this share of a language's sections say nothing about a subject.
COMMON = 0.5
#: Terms in fewer sections cannot be told from misspellings.
RARE = 2
#: Terms of a language's model, those of most sections first.
VOCABULARY = 20_000
LEAST_WORDS = 20
#: Disjoint parts of the sections, and how often each updates the model.
PARTS = 4
EPOCHS = 2
#: Sections per language whose centroids a fit starts from.
START_SECTIONS = 1_500
#: Prior weight of a topic in a section and of a term in a topic.
ALPHA = 0.05
ETA = 0.02
#: Rounds of inference per section.
ROUNDS = 10

_COMMENT_LINE = re.compile(r"^[ \t]*%.*$", re.M)
_COMMENT_TAIL = re.compile(r"(?<!\\)%.*")
_DRAFTS = re.compile(r"\\begin\{comment\}.*?\\end\{comment\}|\\iffalse\b.*?\\fi\b|\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)|\\end\{document\}.*", re.S)
_MARKUP = re.compile(r"\\(?:[a-z]*cite[a-z]*|label|[a-zA-Z]*ref|index|begin|end|bibliography|bibliographystyle|input|include|subfile|includegraphics)\*?(?:\[[^\]]*\])?\{[^}]*\}|\\[A-Za-z]+|\$[^$]*\$")
_HEADING = re.compile(r"\\(?:sub)*section\*?\s*(?:\[[^\]]*\])?\s*\{")
_PREAMBLE = re.compile(r"^.*\\begin\{document\}", re.S)
_WORD = re.compile(r"[^\W\d_]{3,}")

_NAMED = {t: s for s, terms in TERMS.items() for t in terms.split()}
_LETTERS_ONLY = {i: (chr(i).lower() if chr(i).isalpha() else " ") for i in range(128)}
#: Stands for "a section" among the terms that a batch counts.
_SECTIONS = "*"


def _words(text: str) -> list[str]:
    """Words of three or more letters, lower case, marks set aside."""
    text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _DOUBLE_ENCODED.sub(_recode, text))
        text = "".join(c for c in text if not unicodedata.combining(c))
        if not text.isascii():
            return _WORD.findall(text.lower())
    return [w for w in text.translate(_LETTERS_ONLY).split() if len(w) > 2]


def _split(text: str) -> tuple[str, list[Counter]]:
    """The language and the bag of words of each section of one source.  The language is
    that of most function words; a text without any is of the language ``other``."""
    if "%" in text:
        text = _COMMENT_TAIL.sub("", _COMMENT_LINE.sub("", text))
    parts = _HEADING.split(_DRAFTS.sub(" ", text))
    words = [_words(p) for p in parts[1:]] if len(parts) > 1 else [_words(_PREAMBLE.sub("", parts[0]))]
    if len(parts) == 1 and len(words[0]) < LEAST_WORDS:
        return "", []
    bags = [Counter(w) for w in words]
    n = {k: sum(b[w] for b in bags for w in terms) for k, terms in FUNCTION_WORDS.items()}
    lang = max(n, key=n.get)
    return (lang if n[lang] else "other"), bags


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "lang", "section", "terms", "n"]
    for pdf in batches:
        out, tally = [], {}
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            lang, bags = _split(text)
            for i, bag in enumerate(bags):
                out.append((doc_id, lang, i, " ".join(bag), list(bag.values())))
                seen = tally.setdefault(lang, Counter())
                seen.update(bag.keys())
                seen[_SECTIONS] += 1
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        out += [(None, lang, -1, " ".join(seen), list(seen.values())) for lang, seen in tally.items()]
        yield pd.DataFrame(out, columns=columns)


def sections(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, section, terms, n) of whole texts: a row per section or subsection
    with its different words, blank-separated, and how often each occurs.  A text without
    sections is one section if it has LEAST_WORDS words.  Null and empty texts and stubs
    have none.  Rows with section -1 hold, per batch of texts and language, in how many
    sections each word occurs, and the number of sections under ``*``."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    return docs.mapInPandas(_split_batches, "doc_id bigint, lang string, section int, terms string, n array<int>")


def _vocabularies(rows: DataFrame) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Per language its terms by the number of sections that have them, and how many
    sections it has.  Left out are terms in more than COMMON of the sections or in fewer than
    RARE, and the rarest where there would be more than VOCABULARY (terms of equal counts
    go together, so that no list has to be ranked whole)."""
    tally = rows.filter("section = -1").select("lang", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), "n")).alias("x"))
    df = cut(tally.groupBy("lang", F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n")), "term-counts")
    size = {r["lang"]: r["n"] for r in df.filter(F.col("term") == _SECTIONS).collect()}
    if not size:
        return {}, {}
    most = F.create_map(*[x for lang, n in size.items() for x in (F.lit(lang), F.lit(COMMON * n))])
    kept = df.filter((F.col("term") != _SECTIONS) & (F.col("n") >= RARE) & (F.col("n") <= most[F.col("lang")]))
    levels = kept.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    least = levels.withColumn("upto", upto).filter(F.col("upto") <= VOCABULARY).groupBy("lang").agg(F.min("n").alias("least"))  # a row per language
    found = kept.join(F.broadcast(least), "lang").filter("n >= least").select("lang", "term", "n").toPandas().sort_values(["n", "term"], ascending=[False, True])
    out = {lang: [] for lang in size}
    for lang, own in found.groupby("lang"):
        out[lang] = list(own["term"])
    return out, size


def _bag_batches(vocabularies: dict[str, list[str]]):
    index = {lang: {t: i for i, t in enumerate(terms)} for lang, terms in vocabularies.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, counts = [], []
            for lang, terms, n in zip(pdf["lang"], pdf["terms"], pdf["n"]):
                at = index[lang]
                both = [(at[t], k) for t, k in zip(terms.split(" "), n) if t in at]
                ids.append([i for i, _ in both])
                counts.append([k for _, k in both])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "section": pdf["section"], "part": pdf["part"], "ids": ids, "n": counts})

    return run


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function of positive numbers (recurrence, then asymptotic series)."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x += low
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _blocks(lengths: np.ndarray, k: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Rows of like length together, padded to at most ``most`` cells where a row alone is
    not larger."""
    order, i = np.argsort(lengths, kind="stable"), 0
    while i < len(order):
        j = min(len(order), i + max(1, most // (k * max(1, int(lengths[order[i]])))))
        while j > i + 1 and (j - i) * int(lengths[order[j - 1]]) * k > most:
            j = i + (j - i) // 2
        yield order[i:j]
        i = j


def infer(offsets: np.ndarray, ids: np.ndarray, n: np.ndarray, beta: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Topic weights (rows x topics, without the prior) of the bags that ``offsets`` cut out
    of ``ids`` and ``n``.  ``beta``: terms x topics, exp of the expected log weight.  With
    ``sums`` what each topic takes of each term is added to it."""
    k, lengths = beta.shape[1], np.diff(offsets)
    out = np.zeros((len(lengths), k), np.float32)
    for rows in _blocks(lengths, k):
        width = int(lengths[rows[-1]])
        if not width:
            continue
        there = np.arange(width)[None, :] < lengths[rows][:, None]
        at = np.where(there, offsets[rows][:, None] + np.arange(width)[None, :], 0)
        term, count = ids[at], np.where(there, n[at], 0).astype(np.float32)
        b = beta[term]
        theta = np.full((len(rows), k), 1 / k, np.float32)
        for _ in range(ROUNDS):
            share = count / (np.matmul(b, theta[:, :, None])[:, :, 0] + 1e-30)
            taken = theta * np.matmul(share[:, None, :], b)[:, 0, :]
            log = digamma(ALPHA + taken)
            theta = np.exp(log - log.max(axis=1, keepdims=True)).astype(np.float32)
        out[rows] = taken
        if sums is not None:
            share = count / (np.matmul(b, theta[:, :, None])[:, :, 0] + 1e-30)
            flat = term[there]
            for t in range(k):
                sums[:, t] += np.bincount(flat, weights=(share * theta[:, t : t + 1])[there], minlength=len(beta)) * beta[:, t]
    return out


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, rows, offsets, ids, n) of an Arrow batch of bags, language by language."""
    table = pa.Table.from_batches([batch])
    langs = np.array(table["lang"].to_pylist(), dtype=object)
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        own = table.select(["ids", "n"]).take(pa.array(rows)).combine_chunks()
        ids, n = own["ids"].combine_chunks(), own["n"].combine_chunks()
        lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
        yield lang, rows, np.concatenate([[0], np.cumsum(lengths)]), ids.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)


def _betas(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {lang: np.exp(digamma(w) - digamma(w.sum(axis=0, keepdims=True))).astype(np.float32) for lang, w in weights.items()}


def _sum_batches(betas: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(b.shape) for lang, b in betas.items()}
        for batch in batches:
            for lang, _, offsets, ids, n in _bags(batch):
                infer(offsets, ids, n, betas[lang], sums[lang])
        for lang, s in sums.items():
            term = np.flatnonzero(s.any(axis=1))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(term), pa.string()), "term": pa.array(term, pa.int32()), "sums": pa.array(list(s[term]), pa.list_(pa.float64()))})

    return run


def _start(sample: list[tuple[np.ndarray, np.ndarray]], terms: int, k: int, seed: int) -> np.ndarray:
    """Terms x topics: the words of ``k`` clusters of the sample, told apart by the angle
    between bags (roots of counts, rarer terms heavier).  The first centres are drawn far
    from each other."""
    rng = np.random.default_rng(seed)
    raw = np.zeros((len(sample), terms), np.float32)
    for row, (ids, n) in zip(raw, sample):
        row[ids] = n
    held = (raw > 0).sum(axis=0)
    x = np.sqrt(raw) * np.log1p(len(sample) / np.maximum(held, 1)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    chosen = [int((raw > 0).sum(axis=1).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(1, min(k, len(sample))):
        far = np.maximum(1 - near, 0) ** 2
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(10):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    nearest = (x @ centres.T).argmax(axis=1)
    out = np.zeros((terms, k))
    for c in range(len(centres)):
        out[:, c] = raw[nearest == c].sum(axis=0)
    return out


def _drawn(bags: DataFrame, size: dict[str, int]) -> pd.DataFrame:
    """The START_SECTIONS sections of each language with the smallest hashes.  All but some
    four times as many are left out by their hash alone, before any are ranked."""
    h = F.xxhash64("doc_id", "section")
    most = F.create_map(*[x for lang, n in size.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * START_SECTIONS / max(1, n))))])
    near = bags.filter(F.shiftrightunsigned(h, 11) <= most[F.col("lang")] * float(1 << 53))
    pick = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "section"))
    drawn = near.withColumn("_r", pick).filter(F.col("_r") <= START_SECTIONS)
    return drawn.select("lang", "doc_id", "section", "ids", "n").toPandas().sort_values(["lang", "doc_id", "section"])


def fit_topics(bags: DataFrame, vocabularies: dict[str, list[str]], size: dict[str, int], k: int = TOPICS, seed: int = 7, epochs: int = EPOCHS, parts: int = PARTS) -> dict[str, np.ndarray]:
    """Per language the terms x topics weights fitted over all bags (doc_id, lang, section,
    part, ids, n); ``size``: how many there are.  To the driver come, per turn, one row per
    term; there are at most VOCABULARY terms of a language."""
    weights = {}
    for lang, own in _drawn(bags, size).groupby("lang") if size else []:
        weights[lang] = ETA + _start(list(zip(own["ids"], own["n"])), len(vocabularies[lang]), k, seed)
    last: dict[int, dict[str, np.ndarray]] = {}
    for _ in range(epochs):
        for part in range(parts):
            found = bags.filter(F.col("part") == part).select("lang", "ids", "n").mapInArrow(_sum_batches(_betas(weights)), "lang string, term int, sums array<double>")
            found = found.groupBy("lang", "term").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k)]).toPandas()
            last[part] = {lang: np.zeros(w.shape) for lang, w in weights.items()}
            for lang, own in found.groupby("lang"):
                last[part][lang][own["term"].to_numpy()] = own[[f"s{i}" for i in range(k)]].to_numpy()
            for lang in weights:
                weights[lang] = ETA + sum(s[lang] for s in last.values())
    return weights


def map_topics(weights: np.ndarray, vocabulary: list[str], top: int = 30, least: float = 0.05, purity: float = 0.5) -> list[str | None]:
    """The subject of each topic by its ``top`` terms.  Null for a background topic: the
    named terms must hold ``least`` of the top terms' weight, and one subject ``purity`` of
    what they hold."""
    out: list[str | None] = []
    for column in (weights / weights.sum(axis=0)).T:
        weight = dict.fromkeys(SUBJECTS, 0.0)
        terms = np.argsort(-column, kind="stable")[:top]
        for i in terms:
            if vocabulary[i] in _NAMED:
                weight[_NAMED[vocabulary[i]]] += column[i]
        best, all_named = max(weight, key=weight.get), sum(weight.values())
        out.append(best if all_named >= least * column[terms].sum() and weight[best] > purity * all_named else None)
    return out


def _place_batches(betas: dict[str, np.ndarray], subject_of: dict[str, list[str | None]]):
    groups = {lang: np.array([[t == s for s in SUBJECTS] for t in named], np.float32) for lang, named in subject_of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(SUBJECTS, dtype=object)
        for batch in batches:
            subject, share = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows)
            for lang, rows, offsets, ids, n in _bags(batch):
                given = infer(offsets, ids, n, betas[lang]) @ groups[lang]
                total, best = given.sum(axis=1), given.argmax(axis=1)
                of = given.max(axis=1) / np.maximum(total, 1e-9)
                share[rows] = of
                subject[rows] = np.where(of > 0.5, names[best], None)
            out = {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "section": batch.column("section")}
            yield pa.RecordBatch.from_pydict({**out, "subject": pa.array(list(subject), pa.string()), "share": pa.array(share, pa.float64())})

    return run


def section_subjects(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, epochs: int = EPOCHS, parts: int = PARTS) -> DataFrame:
    """(doc_id, lang, section, subject, share) of every section; the subject is null where
    no subject gets more than half of what its topics give subjects, also where none of its
    words is in the model.  Empty tables and languages without terms have no model."""
    rows = cut(sections(documents, doc_id, text), "sections")
    vocabularies, size = _vocabularies(rows)
    kept = rows.filter("section >= 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    schema = "doc_id bigint, lang string, section int, part int, ids array<int>, n array<int>"
    bags = cut(kept.mapInPandas(_bag_batches(vocabularies), schema), "bags", partition="part")
    weights = fit_topics(bags, vocabularies, size, TOPICS, seed, epochs, parts)
    subject_of = {lang: map_topics(w, vocabularies[lang]) for lang, w in weights.items()}
    return bags.select("doc_id", "lang", "section", "ids", "n").mapInArrow(_place_batches(_betas(weights), subject_of), "doc_id bigint, lang string, section int, subject string, share double")


def document_subjects(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.25, seed: int = 7) -> DataFrame:
    """(doc_id, lang, subject, share): the subjects of ``least`` or more of a document's
    sections.  Sections without a subject count among them."""
    placed = section_subjects(documents, doc_id, text, seed)
    each = placed.groupBy("doc_id", "lang", "subject").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("doc_id", "lang").agg(F.sum("n").alias("n_sections"), F.collect_list(F.struct("subject", "n")).alias("x"))
    each = each.select("doc_id", "lang", "n_sections", F.explode("x").alias("x")).filter("x.subject is not null").select("doc_id", "lang", F.col("x.subject").alias("subject"), (F.col("x.n") / F.col("n_sections")).alias("share"))
    return each.filter(F.col("share") >= least)


def agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, labels, hits, labelled_docs, found_pairs): per language how many labelled
    (document, subject) pairs the found subjects hold, and how many pairs were found for
    the labelled documents.  Labels are incomplete and partly wrong, so neither share has
    to be near one.  Documents without a found subject count under the language null."""
    pairs = labels.filter("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    of = found.groupBy("doc_id").agg(F.max("lang").alias("lang"), F.collect_set("subject").alias("subjects"))
    both = pairs.groupBy("doc_id").agg(F.collect_set("subject").alias("said")).join(of, "doc_id", "left")
    hits = F.size(F.array_intersect("said", F.coalesce("subjects", F.array().cast("array<string>"))))
    return both.groupBy("lang").agg(F.sum(F.size("said")).alias("labels"), F.sum(hits).alias("hits"), F.count(F.lit(1)).alias("labelled_docs"), F.sum(F.coalesce(F.size("subjects"), F.lit(0))).alias("found_pairs"))
