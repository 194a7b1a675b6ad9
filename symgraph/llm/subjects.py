"""Subject areas of documents: weighted terms, a truncated SVD, and centroids grown from labelled seeds.

A document is a row of the document-by-term matrix: the logarithm of how often a term occurs, times its inverse document
frequency, times how much the term tells of subjects, made a unit vector. Orthogonal iteration over all documents gives
the leading right singular vectors. Sentences and documents are embedded by them, and sentences go to the nearest
centroid by cosine; in each round the weights, the axes and the centroids are made anew from all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.leaks import _BRACKETS, _FURNITURE, _LINE_END, _MOJIBAKE
from symgraph.session import stored

#: Singular vectors kept: more than there are subjects in all languages, far fewer than terms.
RANK = 48
#: Steps of the orthogonal iteration before the first round, with one more in each round; rounds.
STEPS, ROUNDS = 3, 2
#: A term of the vocabulary is in this share of all documents, and in FEWEST of them. The share bounds the vocabulary at
#: any size of the corpus: at most the mean number of distinct terms of a document, divided by it.
COMMON, FEWEST = 2e-4, 3
#: Labelled documents used as seeds; of more, those with the smallest hash are taken. Everything else covers all documents.
SEEDS = 50_000
#: Most subjects; more are refused.
MOST_SUBJECTS = 256
#: Counts added to a term's subjects, in the proportions of its language; the least divergence of a term that tells of
#: subjects, in parts of the logarithm of the number of classes.
SMOOTHING, DIVERGENCE = 10.0, 0.15
#: The least sum of the divergences of a sentence that deals with an area, in parts of the same logarithm; the least
#: cosine; the weight of the document's other sentences; the least share of an area.
STRENGTH, NEAR, CONTEXT, SHARE = 0.1, 0.02, 0.7, 0.25
#: Terms embedded at once.
BLOCK = 200_000

#: Frequent words that tell the languages apart.
STOP_WORDS = {
    "en": "the and of to that is for have not we was are",
    "de": "der die das und nicht ist wir den zu mit sie hat",
    "fr": "le la les et des ne pas est que nous une du",
}
#: How a chair names the items of an agenda. Such sentences are no areas and the seeds of procedure.
FORMULAS = (
    "the next item is", "that concludes the debate on", "we come to the item", "we now come to", "the house will now consider",
    "ich rufe auf", "wir kommen zu", "damit schließe ich die aussprache", "l'ordre du jour appelle", "nous passons à", "la parole est à",
    "das wort hat", "i call",
)
#: What a full stop does not end. Patterns begin with the mark they seek, so that texts are passed over fast.
_SHORT = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Abg", "St", "Nr", "Mme", "Hon")
_ABBREVIATION = re.compile(r"\.(?=\s)(?:" + "|".join(rf"(?<=\b{x}\.)" for x in _SHORT) + r"|(?<=\b[A-Z]\.)(?=\s+[A-Z]))")
_SENTENCE = re.compile(r"[.!?…][\"”»“]?\s+|\n\s*\n")
_ASIDE = re.compile(r"[–—]\s+[^–—\n]{1,80}:\s[^–—\n]{1,80}[!?.]\s+[–—]")
_DASHES = re.compile(r"[–—]\s*[–—]")
_TERM = re.compile(r"[^\W\d_]{2,}")
_STOPS = {w: k for k, words in enumerate(STOP_WORDS.values()) for w in words.split()}
GROUPS = len(STOP_WORDS) + 1


def cleaned(text: str) -> str:
    """A speech without interruptions, page furniture, damaged encoding and broken words, with \\0 between its sentences."""
    text = text.replace("\0", " ")
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
    if "\n" in text:
        text = _LINE_END.sub("", _FURNITURE.sub(" ", text))
    if "(" in text or "[" in text:
        text = _BRACKETS.sub(" ", text)
    if "–" in text or "—" in text:
        text = _DASHES.sub(" ", _ASIDE.sub(" ", text))
    if "." in text:
        text = _ABBREVIATION.sub("", text)
    return _SENTENCE.sub("\0", text)


class Terms:
    """Numbers of terms: the group of the language in the top bits, then a hash."""

    def __init__(self) -> None:
        self.known: list[dict[str, int]] = [{} for _ in range(GROUPS)]

    def of(self, text: str) -> tuple[int, list[list[int]], list[bool]]:
        """The language group, the distinct terms of each sentence, and which sentences are formulas of the chair."""
        text = cleaned(text).lower()
        told = [f for f in FORMULAS if f in text]
        sentences, formulas = [], []
        for sentence in text.split("\0"):
            if words := _TERM.findall(sentence):
                sentences.append(words)
                formulas.append(any(f in sentence for f in told))
        votes = [0] * (GROUPS - 1)
        for k in [_STOPS[w] for s in sentences for w in s if w in _STOPS]:
            votes[k] += 1
        group = votes.index(max(votes)) if any(votes) else GROUPS - 1
        known = self.known[group]
        if len(known) > 500_000:
            known.clear()
        out = []
        for s in sentences:
            try:
                out.append([known[w] for w in dict.fromkeys(s)])
            except KeyError:
                for w in s:
                    if w not in known:
                        known[w] = group << 61 | xxhash.xxh64_intdigest(w) >> 3
                out.append([known[w] for w in dict.fromkeys(s)])
        return group, out, formulas


class Vocabulary(NamedTuple):
    """The sorted numbers of the terms, and their inverse document frequencies within their language."""

    terms: np.ndarray
    idf: np.ndarray

    @property
    def groups(self) -> np.ndarray:
        return self.terms >> 61

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, -1 for those that are not in the vocabulary."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


class Model(NamedTuple):
    """Weights of the terms, how much they tell, the axes of the SVD, and unit centroids by language and class."""

    weights: np.ndarray
    tells: np.ndarray
    axes: np.ndarray
    centroids: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and where each begins."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[starts], starts


def divergences(counts: np.ndarray, groups: np.ndarray, smoothing: float) -> np.ndarray:
    """How much each term tells: the divergence of its subjects from those of its language, less DIVERGENCE."""
    out = np.zeros(len(counts))
    for k in range(GROUPS):
        part = counts[groups == k]
        if not part.any():
            continue
        prior = (part.sum(0) + 1e-9) / (part.sum() + 1e-9)
        p = (part + smoothing * prior) / (part.sum(1, keepdims=True) + smoothing)
        out[groups == k] = np.maximum(0, (p * np.log(p / prior)).sum(1) - DIVERGENCE * np.log(counts.shape[1]))
    return out


def orthogonal(table: np.ndarray) -> np.ndarray:
    """The orthonormal axes of the columns, those of the largest singular values first; columns without rank are dropped.

    A table of zeros, as no term tells of subjects, keeps one axis of zeros.
    """
    if not table.any():
        return np.zeros((len(table), 1))
    values, vectors = np.linalg.eigh(table.T @ table)
    kept = values > 1e-10 * values[-1]
    return ((table @ vectors[:, kept]) / np.sqrt(values[kept]))[:, ::-1]


class Part:
    """Some documents as flat arrays: sentences with their document, terms with their sentence."""

    def __init__(self, batch: pa.RecordBatch):
        sizes = batch.column("sizes")
        self.docs = len(sizes)
        self.group = np.asarray(batch.column("lang")).astype(np.int64)
        self.owner = np.repeat(np.arange(self.docs), np.diff(np.asarray(sizes.offsets)))
        self.sizes = np.asarray(sizes.flatten()).astype(np.int64)
        self.terms = np.asarray(batch.column("terms").flatten()).astype(np.int64)
        self.formula = np.asarray(batch.column("formulas").flatten().cast(pa.uint8())).astype(bool)
        self.n = len(self.sizes)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def by_doc(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The non-zero entries of the documents' unit rows: document, term, value."""
        kept = weights[self.terms] > 0
        width = len(weights)
        key, often = np.unique(self.owner[self.row[kept]] * width + self.terms[kept], return_counts=True)
        doc, term = key // width, key % width
        value = weights[term] * np.log1p(often)
        norm = np.sqrt(np.bincount(doc, value**2, self.docs))
        return doc, term, value / norm[doc]

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """For each sentence the sum of its terms' rows, made in blocks."""
        out = np.zeros((self.n, vectors.shape[1]), np.float32)
        live = np.flatnonzero(np.abs(vectors).sum(1)[self.terms] > 0)
        for k in range(0, len(live), BLOCK):
            at = live[k : k + BLOCK]
            rows, starts = runs(self.row[at])
            out[rows] += np.add.reduceat(vectors[self.terms[at]], starts, axis=0)
        return out

    def assigned(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences the class, whether they have one, the vector; of the documents the sentences by class.

        The last class is procedure. A class that the document has in other sentences is nearer.
        """
        classes = model.centroids.shape[1]
        z = self.sums((model.weights[:, None] * model.axes).astype(np.float32))
        strength = np.bincount(self.row, model.tells[self.terms], self.n)
        cosine = np.zeros((self.n, classes), np.float32)
        group = self.group[self.owner]
        length = np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
        for g in range(GROUPS):
            at = group == g
            cosine[at] = z[at] / length[at] @ model.centroids[g].T.astype(np.float32)
        most = cosine.max(axis=1, initial=-1)
        live = ((strength > STRENGTH * np.log(classes)) & (most > NEAR)) | self.formula
        best = np.where(self.formula, classes - 1, cosine.argmax(axis=1)) if self.n else np.zeros(0, np.int64)
        counts = self.counted(best, live, classes)
        shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        score = cosine / np.maximum(most, 1e-9)[:, None] + CONTEXT * np.log(shares[self.owner] + 0.02)
        best = np.where(self.formula, classes - 1, score.argmax(axis=1)) if self.n else best
        return best, live, z, self.counted(best, live, classes)

    def counted(self, best: np.ndarray, live: np.ndarray, classes: int) -> np.ndarray:
        flat = np.bincount(self.owner[live] * classes + best[live], minlength=self.docs * classes)
        return flat.reshape(self.docs, classes).astype(np.float64)

    def seeds(self, given: list[list[int]], classes: int) -> np.ndarray:
        """The classes of the seeds: the labels, else procedure as far as the sentences are formulas."""
        out = np.zeros((self.docs, classes))
        for k, numbers in enumerate(given):
            for s in numbers:
                out[k, s] = 1 / len(numbers)
        share = np.bincount(self.owner, self.formula, self.docs) / np.maximum(np.bincount(self.owner, minlength=self.docs), 1)
        out[:, -1] = np.where(out.any(axis=1), 0, share)
        return out

    def added(self, table: np.ndarray, weights: np.ndarray) -> None:
        """Adds to the terms' rows of `table` the sentences' rows of `weights`."""
        width = table.shape[1]
        order = np.argsort(-weights, axis=1, kind="stable")
        for k in range(int((weights > 0).sum(axis=1).max(initial=0))):  # few sentences have many classes
            cls = order[:, k]
            weight = np.take_along_axis(weights, cls[:, None], axis=1)[:, 0]
            at = np.flatnonzero((weight > 0)[self.row])
            row = self.row[at]
            table += np.bincount(self.terms[at] * width + cls[row], weight[row], table.size).reshape(table.shape)

    def pulled(self, z: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """The sums of the documents' unit vectors by language and class."""
        docs = np.zeros((self.docs, z.shape[1]))
        if self.n:
            owners, starts = runs(self.owner)
            docs[owners] = np.add.reduceat(z, starts, axis=0)
        out = np.zeros((GROUPS, shares.shape[1], z.shape[1]))
        for g in range(GROUPS):
            at = self.group == g
            out[g] = shares[at].T @ unit(docs[at])
        return out


def parts(batches: Iterator[pa.RecordBatch], most: int = 2 * BLOCK) -> Iterator[tuple[Part, pa.RecordBatch]]:
    """The batches cut into parts of about `most` terms, so that memory is bounded."""
    for batch in batches:
        ends = np.asarray(batch.column("terms").offsets)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            piece = batch.slice(start, stop - start)
            yield Part(piece), piece
            start = stop


def _columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def _emitted(table: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of `table` that are not zero, by number; the numbers of `extra` in further rows, counted from -1 down."""
    keys = np.flatnonzero(table.any(axis=1))
    values, width = table[keys], table.shape[1]
    if extra is not None:
        flat = np.zeros(-(-extra.size // width) * width)
        flat[: extra.size] = extra.ravel()
        rows = flat.reshape(-1, width)
        keys, values = np.concatenate([keys, -1 - np.arange(len(rows))]), np.concatenate([values, rows])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(values[:, k], pa.float64()) for k in range(width)]], ["key", *_columns(width)])


def _gathered(rows: DataFrame, work, size: int, width: int, extra: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what the tasks emit: a table of the vocabulary's size, and an array of shape `extra`.

    Spark adds up the tasks' tables; the driver gets one row for each term of the vocabulary.
    """
    schema = "key int, " + ", ".join(f"{c} double" for c in _columns(width))
    sums = rows.mapInArrow(work, schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in _columns(width)]).toPandas()
    keys, values = sums["key"].to_numpy(), sums[_columns(width)].to_numpy()
    table, more = np.zeros((size, width)), np.zeros((int(np.prod(extra)) if extra else 0))
    table[keys[keys >= 0]] = values[keys >= 0]
    if extra:
        rest = np.zeros((-(-more.size // width), width))
        rest[-1 - keys[keys < 0]] = values[keys < 0]
        more = rest.ravel()[: more.size].reshape(extra)
    return table, more


def named(subjects: DataFrame) -> list[str]:
    """The names of the subjects in order; more than MOST_SUBJECTS raise an error."""
    names = sorted(r[0] for r in subjects.select("subject").filter("subject <> ''").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return names


def featured(docs: DataFrame, labels: DataFrame, names: list[str]) -> tuple[DataFrame, Vocabulary]:
    """The vocabulary, and a table of doc_id, lang, sentence sizes, places of the terms, formulas and labelled subjects.

    The texts are read once; document frequencies cover all documents.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(t) for t in batch.column(1).to_pylist()]
            every = [s for f in found for s in f[1]]
            sizes = np.fromiter(map(len, every), np.int64, len(every))
            ends = np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(every), np.int64, int(sizes.sum()))
            term_ends = pa.array(np.concatenate([[0], np.cumsum(sizes)])[ends].astype(np.int32))
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int8()), pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes.astype(np.int32)))]
            columns += [pa.ListArray.from_arrays(term_ends, pa.array(flat)), pa.ListArray.from_arrays(pa.array(ends), pa.array([x for f in found for x in f[2]], pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "sizes", "terms", "formulas"])

    kept = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    words = stored(kept.mapInArrow(split, "doc_id long, lang tinyint, sizes array<int>, terms array<long>, formulas array<boolean>"))
    by_lang = dict(words.groupBy("lang").count().collect())
    least = max(FEWEST, COMMON * sum(by_lang.values()))
    often = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().filter(F.col("count") >= least)
    rows = often.orderBy("term").toPandas()
    terms = rows["term"].to_numpy(np.int64)
    total = np.array([by_lang.get(k, 0) for k in range(GROUPS)], float)
    vocabulary = Vocabulary(terms, np.log((1 + total[terms >> 61]) / (1 + rows["count"].to_numpy(float))))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes, formulas = batch.column("terms"), batch.column("sizes"), batch.column("formulas")
            flat = np.asarray(sizes.flatten()).astype(np.int64)
            places = shared.value.places(np.asarray(lists.flatten()))
            sentence = np.repeat(np.arange(len(flat)), flat)[places >= 0]
            left = np.bincount(sentence, minlength=len(flat))
            flags = np.asarray(formulas.flatten().cast(pa.uint8())).astype(bool)
            live = (left > 0) | flags
            owner = np.repeat(np.arange(len(sizes)), np.diff(np.asarray(sizes.offsets)))
            ends = lambda at: pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(sizes)))]), pa.int32())
            of = ends(owner[live])
            columns = [batch.column("doc_id"), batch.column("lang"), pa.ListArray.from_arrays(of, pa.array(left[live], pa.int32()))]
            columns += [pa.ListArray.from_arrays(ends(owner[sentence]), pa.array(places[places >= 0], pa.int32())), pa.ListArray.from_arrays(of, pa.array(flags[live]))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("given")], ["doc_id", "lang", "sizes", "terms", "formulas", "given"])

    number = F.create_map(*[F.lit(x) for k, s in enumerate(["", *names]) for x in (s, k - 1)])
    labelled = labels.select("doc_id", number[F.col("subject")].alias("_s")).filter("_s >= 0 and doc_id is not null")
    seeds = labelled.groupBy("doc_id").agg(F.sort_array(F.collect_set("_s")).alias("given")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEEDS)
    given = F.coalesce("given", F.array().cast("array<int>"))
    # At most SEEDS rows of an id and at most MOST_SUBJECTS numbers.
    rows = words.join(F.broadcast(seeds), "doc_id", "left").select("doc_id", "lang", "sizes", "terms", "formulas", given.alias("given"))
    return stored(rows.mapInArrow(encode, "doc_id long, lang tinyint, sizes array<int>, terms array<int>, formulas array<boolean>, given array<int>")), vocabulary


def _stepped(rows: DataFrame, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """One step of the orthogonal iteration: the axes of X'X times `axes`, X being the matrix of all documents' unit rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, axes.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, axes = shared.value
        total = np.zeros(axes.shape)
        for part, _ in parts(batches):
            doc, term, value = part.by_doc(weights)
            if not len(doc):
                continue
            docs, starts = runs(doc)
            y = np.zeros((part.docs, axes.shape[1]), np.float32)
            y[docs] = np.add.reduceat(value[:, None].astype(np.float32) * axes[term], starts, axis=0)
            order = np.argsort(term, kind="stable")
            terms, starts = runs(term[order])
            total[terms] += np.add.reduceat(value[order, None].astype(np.float32) * y[doc[order]], starts, axis=0)
        yield _emitted(total)

    return orthogonal(_gathered(rows.select("lang", "sizes", "terms", "formulas"), work, *axes.shape)[0])


def learned(rows: DataFrame, vocabulary: Vocabulary, described: list[np.ndarray]) -> Model:
    """The model: seeds first, then rounds over all documents.

    In each round every document's sentences go to the nearest centroid by cosine; a term then counts for the classes of
    the *other* sentences of its document, so that a set phrase can't speak for itself. Documents of one area count more.
    Tasks send tables of the vocabulary's size, never documents. `described` has the terms of the subjects' descriptions.
    """
    n, size = len(described) + 1, len(vocabulary.terms)
    spark = rows.sparkSession
    seeds = rows.filter(F.exists("formulas", lambda x: x) | (F.size("given") > 0))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, n))
        for part, batch in parts(batches):
            part.added(total, part.seeds(batch.column("given").to_pylist(), n)[part.owner])
        yield _emitted(total)

    counts, _ = _gathered(seeds, seed, size, n)
    for k, terms in enumerate(described):
        counts[terms, k] += 1
    tells = divergences(counts, vocabulary.groups, SMOOTHING / 5)
    weights = tells * vocabulary.idf
    axes = np.linalg.qr(np.random.default_rng(size).standard_normal((size, min(RANK, size))))[0]
    for _ in range(STEPS):
        axes = _stepped(rows, weights, axes)
    shared = spark.sparkContext.broadcast((weights[:, None] * axes).astype(np.float32))
    rank = axes.shape[1]

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((GROUPS, n, rank))
        for part, batch in parts(batches):
            sums += part.pulled(part.sums(shared.value), part.seeds(batch.column("given").to_pylist(), n))
        yield _emitted(np.zeros((0, n)), sums)

    sums = _gathered(seeds, centre, 0, n, (GROUPS, n, rank))[1]
    for k, terms in enumerate(described):
        for g in range(GROUPS):
            at = terms[vocabulary.groups[terms] == g]
            sums[g, k] += unit((weights[at, None] * axes[at]).sum(axis=0))
    model = Model(weights, tells, axes, unit(sums))
    for _ in range(ROUNDS):
        current = spark.sparkContext.broadcast(model)

        def assign(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros((size, n)), np.zeros((GROUPS, n, current.value.axes.shape[1]))
            for part, _ in parts(batches):
                best, live, z, counts = part.assigned(current.value)
                shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
                sums += part.pulled(z, shares * (shares**2).sum(1, keepdims=True))
                others = counts[part.owner]
                others[np.flatnonzero(live), best[live]] -= 1
                others /= np.maximum(others.sum(1, keepdims=True), 1)
                part.added(total, others * (others**2).sum(1, keepdims=True))
            yield _emitted(total, sums)

        counts, sums = _gathered(rows, assign, size, n, (GROUPS, n, model.axes.shape[1]))
        tells = divergences(counts, vocabulary.groups, SMOOTHING)
        weights = tells * vocabulary.idf
        axes = _stepped(rows, weights, model.axes)
        # The centroids found with the old axes, seen on the new ones.
        model = Model(weights, tells, axes, unit(sums @ (model.axes.T @ axes)))
    return model


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """For every document the areas its sentences deal with: doc_id, subject, n_sentences, share.

    Interruptions, page furniture, agenda formulas and sentences without telling terms do not count. Documents of null
    id or text, and those without a telling sentence, give no rows. Labels may be wrong, missing or repeated; labels of
    unknown subjects are ignored, and without labels the descriptions alone are the seeds. No subjects give no rows.
    Of repeated rows of a document each is judged, and equal results fall together. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    names = named(subjects)
    schema = "doc_id long, subject string, n_sentences long, share double"
    if not names:
        return spark.createDataFrame([], schema)
    rows, vocabulary = featured(docs, labels, names)
    if not len(vocabulary.terms):
        return spark.createDataFrame([], schema)
    n, hashed, described = len(names), Terms(), []
    texts = {r[0]: r[1] or "" for r in subjects.filter(F.col("subject").isin(names)).groupBy("subject").agg(F.max("description")).collect()}
    for name in names:
        numbers = {t for s in hashed.of(f"the {texts[name]} of the {name}")[1] for t in s}
        places = vocabulary.places(np.array(sorted(numbers), np.int64))
        described.append(places[places >= 0])
    shared = spark.sparkContext.broadcast((learned(rows, vocabulary, described), np.array(names, object)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, named = shared.value
        for part, batch in parts(batches):
            counts = part.assigned(model)[3][:, :n]
            total = np.maximum(counts.sum(1), 1)
            doc, s = np.nonzero(counts)
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(named[s], pa.string()), pa.array(counts[doc, s].astype(np.int64)), pa.array(counts[doc, s] / total[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "subject", "n_sentences", "share"])

    return rows.select("doc_id", "lang", "sizes", "terms", "formulas").mapInArrow(judge, schema).distinct()
