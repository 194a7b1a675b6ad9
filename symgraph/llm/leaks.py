"""Evaluation texts inside training text: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.session import stored

#: Words a shingle. Five-word shingles would leave 20 words with two changes as few as six of 16; three leave 12 of 18.
SHINGLE = 3
#: Upper sizes of the partitions, in shingles. Longer documents are cut into overlapping domains of the last size.
SIZES = (16, 28, 40)
#: A passage keeps at least this share of its shingles; the chance to miss one that does is at most MISS.
CONTAINMENT, MISS = 0.5, 1e-6
#: Items a block. An item's part of the index is at most about 100 kB, so a block's index is at most 50 MB.
BLOCK, ITEM_WORDS = 500, 400
#: Items under so many words are found by their shingles themselves, as MinHash would need too many functions for them.
SHORT = 7
#: Documents looked at together.
TOGETHER = 1000
_SCHEMA = "doc_id long, item_id long, words int, errors int"

_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿]")
_LINE_END = re.compile(r"[-­‐](?<=\w[-­‐])\s*\n\s*(?=\w)")
_FURNITURE = re.compile(r"(?m)^[^\S\n]*\w+[^\S\n]+\d+[^\S\n]+[-–—][^\S\n]+\d+[^\S\n]+[-–—][^\S\n]*\r?$")
_PAGE = re.compile(r"[-–—]\s*\d+\s*[-–—]")
_GLUE = re.compile(r"['’ʼ\-­‐](?<=\w['’ʼ\-­‐])(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_BRACKETS = re.compile(r"\([^()\[\]]*(?:[(\[][^()\[\]]*[)\]][^()\[\]]*)*\)|\[[^()\[\]]*(?:[(\[][^()\[\]]*[)\]][^()\[\]]*)*\]")
#: The usual marks on letters.
_MARKS = re.compile("[\u0300-\u036f]+")
_DASHED = re.compile(r"[–—]\s[^–—\n]{1,120}\s[–—]")


def plain(text: str) -> str:
    """Text without case, accents, damaged encoding, page furniture and words broken at line ends."""
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
    if "\n" in text:
        text = _LINE_END.sub("", _FURNITURE.sub(" ", text))
    text = _GLUE.sub("", _PAGE.sub(" ", text))
    if text.isascii():
        return text.lower()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold().replace("œ", "oe").replace("æ", "ae")))
    rare = [c for c in set(text) if c > "\u036f" and unicodedata.combining(c)]
    return text.translate(dict.fromkeys(map(ord, rare))) if rare else text


class Words:
    """Stable 64-bit hashes of words, kept for those seen often."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        return np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for every run of SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def functions_for(size: int, query: int) -> int:
    """How many MinHash functions find a query of `query` shingles in a domain of up to `size` with a miss of MISS.

    With bands of one function, the chance to miss is (1 - s) ** b for the Jaccard similarity s to which CONTAINMENT
    comes at the partition's upper size.
    """
    s = CONTAINMENT / (size / query + 1 - CONTAINMENT)
    return math.ceil(math.log(MISS) / math.log(1 - s))


_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, 256, np.uint64)


def minhashes(hashes: np.ndarray, functions: int) -> np.ndarray:
    """Row i: the hashes under function i, whose least is the MinHash. The last byte is i, so that one table holds all."""
    h = hashes[None, :] * _FACTORS[:functions, None] + _SHIFTS[:functions, None]
    return ((h ^ (h >> np.uint64(31))) & np.uint64(2**64 - 256)) | np.arange(functions, dtype=np.uint64)[:, None]


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    shingles: np.ndarray


class Text(NamedTuple):
    """The words of a plain text and the runs of words that may be an interruption, as (first word, word after)."""

    words: list[str]
    brackets: list[tuple[int, int]]
    dashed: list[tuple[int, int]]


def read(text: str) -> Text:
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]

    def runs(pattern: re.Pattern) -> list[tuple[int, int]]:
        found = [(bisect_left(starts, m.start()), bisect_left(starts, m.end())) for m in pattern.finditer(text)]
        return [(a, z) for a, z in found if a < z]

    brackets = runs(_BRACKETS) if "(" in text or "[" in text else []
    dashed = runs(_DASHED) if "\u2013" in text or "\u2014" in text else []
    return Text([text[a:z] for a, z in spans], brackets, dashed)


def without(size: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """The places of the words outside the runs."""
    keep = np.ones(size, bool)
    for a, z in runs:
        keep[a:z] = False
    return np.flatnonzero(keep)


class Index:
    """MinHashes of all passages of the items, for each partition of domain sizes."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.items, hashes = least, [], Words()
        found: dict[int, set[int]] = defaultdict(set)
        exact: dict[int, set[int]] = defaultdict(set)
        most = 0
        for item_id, text in rows:
            parts = read(plain(text))
            words = hashes.of(parts.words)
            bare = words[without(len(words), parts.brackets)]
            sets = [s for s in (shingles(words), shingles(bare) if len(bare) < len(words) else ()) if len(s)]
            if not sets:
                continue
            self.items.append(Item(item_id, words, np.unique(np.concatenate(sets))))
            for s in sets:
                width = max(1, min(len(s), least - SHINGLE + 1))
                if width < SHORT - SHINGLE + 1:
                    for value in s.tolist():
                        exact[value].add(len(self.items) - 1)
                    continue
                b = max(functions_for(size, width) for size in SIZES)  # fewer than there are, for SHORT words or more
                most = max(most, b)
                runs = np.lib.stride_tricks.sliding_window_view(minhashes(s, b), width, axis=1).min(axis=2)
                for value in np.unique(runs).tolist():
                    found[value].add(len(self.items) - 1)
        every = [i.shingles for i in self.items]
        self.every = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.fewest = min((self.fewest_shared(i) for i in self.items), default=0)
        self.values = np.array(sorted(found), np.uint64)
        self.owners = [sorted(found[v]) for v in sorted(found)]
        self.exact = np.array(sorted(exact), np.uint64)
        self.exact_owners = [sorted(exact[v]) for v in sorted(exact)]
        self.functions = {size: min(most, functions_for(size, max(1, least - SHINGLE + 1))) for size in SIZES}
        short = any(SHORT <= len(i.words) < least for i in self.items)
        if short:  # short items need all functions in every partition
            self.functions = dict.fromkeys(SIZES, most)

    def fewest_shared(self, item: Item) -> int:
        """Shingles that a passage of the item keeps: an error takes SHINGLE at most, a word or two go where a bracket opens."""
        return min(len(item.words), self.least) - SHINGLE + 1 - (self.least // 10) * SHINGLE - 2

    def candidates(self, hashes: np.ndarray) -> dict[int, tuple[int, int]]:
        """Items that share a MinHash with a domain of the document: item number to first and last word."""
        out: dict[int, tuple[int, int]] = {}
        n = len(hashes)
        if not n or not self.items:
            return out

        def add(item: int, a: int, z: int) -> None:
            x, y = out.get(item, (a, z))
            out[item] = (min(a, x), max(z, y))

        if len(self.exact):
            place = np.minimum(np.searchsorted(self.exact, hashes), len(self.exact) - 1)
            for d in np.flatnonzero(self.exact[place] == hashes).tolist():
                for item in self.exact_owners[place[d]]:
                    add(item, d, d + 1)
        if not len(self.values):
            return out
        size = next((s for s in SIZES if n <= s), SIZES[-1])
        b, half = self.functions[size], SIZES[-1] // 2
        table = minhashes(hashes, b)
        if n <= SIZES[-1]:
            mins, starts, length = table.min(axis=1)[:, None], [0], n
        else:
            cuts = np.arange(0, n, half)
            halves = np.minimum.reduceat(table, cuts, axis=1)
            mins, starts, length = np.minimum(halves[:, :-1], halves[:, 1:]), cuts.tolist(), 2 * half
        place = np.searchsorted(self.values, mins)
        place[place == len(self.values)] = 0
        for f, d in np.argwhere(self.values[place] == mins).tolist():
            a, z = starts[d], starts[d] + length
            for item in self.owners[place[f, d]]:
                add(item, a, z)
        return out


def held(item: np.ndarray, text: np.ndarray, skips: list[tuple[int, int]], least: int) -> tuple[int, int] | None:
    """The run of the item's words with the fewest errors, at most one in ten words, and its words: (words, errors).

    Changed, added and left out words are errors; a run begins and ends with a word that is held. The interruptions
    `skips` of the text may be passed over. For each number of errors, a table row holds the earliest start of a run
    that ends at an item word and a text word.
    """
    n, m = len(item), len(text)
    if not n or not m:
        return None
    need = min(least, n)
    # A passage has at most one missing word in ten, so some `need` words of the item miss no more than this.
    there = np.concatenate([[0], np.cumsum(np.isin(item, text))])
    if (there[need:] - there[:-need]).max() < need - max(0, 2 * need - 1) // 10:
        return None
    far = 1 << 30
    same = item[:, None] == text[None, :]
    place = np.arange(n)
    before = None
    for e in range(n // 10 + 1):
        now, ends = np.full((n + 1, m + 1), far, np.int32), np.full(n, far)
        for i in range(1, n + 1):
            row = np.where(same[i - 1], np.minimum(now[i - 1, :-1], i - 1), far)
            ends[i - 1] = row.min()
            if before is not None:
                np.minimum(row, before[i - 1, :-1], out=row)
                np.minimum(row, before[i, :-1], out=row)
                np.minimum(row, before[i - 1, 1:], out=row)
            now[i, 1:] = row
            for a, z in skips:
                if now[i, a] < now[i, z]:
                    now[i, z] = now[i, a]
        span = place - ends + 1
        k = int(span.argmax())
        if span[k] >= max(need, 10 * e):
            return int(span[k]), e
        before = now
    return None


def likely(texts: list[str], known: np.ndarray, fewest: int, words: Words) -> np.ndarray:
    """Which plain texts share enough shingles with the items to hold a passage of any. Loses nothing.

    Leaving out an interruption makes two new shingles at most, and each begins with a mark that is counted here.
    """
    lists = [_WORD.findall(t) for t in texts]
    ends = np.cumsum([len(x) for x in lists])
    hits = np.concatenate([[0], np.cumsum(among(shingles(words.of([w for x in lists for w in x])), known))])
    first = np.minimum(np.concatenate([[0], ends[:-1]]), len(hits) - 1)
    last = np.clip(ends - SHINGLE + 1, first, len(hits) - 1)
    marks = np.array([sum(map(t.count, "([–—")) for t in texts])
    return hits[last] - hits[first] + (SHINGLE - 1) * marks >= max(1, fewest)


def passages(index: Index, text: str, words: Words) -> Iterator[tuple[int, int, int]]:
    """(item_id, words, errors) of the items of which the plain text holds a passage."""
    parts = read(text)
    hashed = words.of(parts.words)
    forms = [np.arange(len(hashed))]
    if parts.brackets:
        forms.append(without(len(hashed), parts.brackets))
    if parts.dashed:
        forms.append(without(len(hashed), parts.brackets + parts.dashed))
    skips = sorted(parts.brackets + parts.dashed, key=lambda r: r[::-1])
    best: set[int] = set()
    for at in forms:
        own = shingles(hashed[at])
        hits = np.flatnonzero(among(own, index.every))
        if len(hits) < max(1, index.fewest):
            continue
        # A domain that holds a passage holds one of these shingles.
        begin = max(0, int(hits[0]) - SIZES[-1])
        for number, (a, z) in index.candidates(own[begin : int(hits[-1]) + 1 + SIZES[-1]]).items():
            a, z = a + begin, z + begin
            item = index.items[number]
            if item.item_id in best:
                continue
            there = among(own[a:z], item.shingles)
            if there.sum() < index.fewest_shared(item) or len(np.unique(own[a:z][there])) < index.fewest_shared(item):
                continue
            first = max(0, int(at[a]) - len(item.words))
            last = min(len(hashed), int(at[min(len(at), z + SHINGLE) - 1]) + len(item.words))
            near = [(x - first, y - first) for x, y in skips if first <= x and y <= last]
            if hit := held(item.words, hashed[first:last], near, index.least):
                best.add(item.item_id)
                yield item.item_id, *hit


def leaks(docs: DataFrame, items: DataFrame, least: int = 20) -> DataFrame:
    """Every document that holds an item or at least `least` of its words in a row: doc_id, item_id, words, errors.

    The documents are read once and never shuffled: domains of bounded size are cut from each, their MinHashes are
    looked up in the index of all passages of the items, and candidates are verified by exact shingle containment and
    then by aligning words, of which one in ten may be changed, added or left out. The items are the stated query set;
    they come in blocks of BLOCK, whose index has a size bound. With more than one block, a first pass keeps the
    documents that share enough shingles with any item, so the corpus itself is read once, however many items there are.

    Items shorter than `least` words must be held whole (in full if under ten words); items under three words and
    documents of null or empty text give no rows. Items above ITEM_WORDS words are cut into overlapping parts, so they
    count against the bound as several. Repeated rows give repeated pairs once for each document row; the result is
    distinct. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = iter(items.select("item_id", "text").filter("text is not null and item_id is not null").distinct().toLocalIterator())
    parts = ((r["item_id"], p) for r in rows for p in _parts(r["text"], least))
    blocks = []
    while block := list(islice(parts, BLOCK)):
        blocks.append(Index(block, least))
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    if len(blocks) > 1:
        # Only what may hold a passage of any item is looked at again, block by block; 8 bytes for each word of the items.
        known = spark.sparkContext.broadcast((np.unique(np.concatenate([b.every for b in blocks])), min(b.fewest for b in blocks)))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in _pieces(batches):
                kept = likely([plain(t) for t in batch.column(1).to_pylist()], *known.value, words)
                yield batch.filter(pa.array(kept))

        texts = stored(texts.mapInArrow(keep, "doc_id long, text string"))
    out = None
    for block in blocks:
        index = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in _pieces(batches):
                plains = [plain(t) for t in batch.column(1).to_pylist()]
                kept = np.flatnonzero(likely(plains, index.value.every, index.value.fewest, words)).tolist()
                ids = batch.column(0).to_pylist() if kept else []
                found = [(ids[k], *hit) for k in kept for hit in passages(index.value, plains[k], words)]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "words", "errors"])

        hits = texts.mapInArrow(search, _SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], _SCHEMA)
    top = F.max(F.struct("words", (-F.col("errors")).alias("less"))).alias("_top")
    return out.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", F.col("_top.words").alias("words"), (-F.col("_top.less")).alias("errors"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(k, TOGETHER)


def _parts(text: str, least: int) -> Iterator[str]:
    """The text, cut so that no part is above ITEM_WORDS words and every passage of twice `least` words is in one part."""
    words = text.split()
    if len(words) <= ITEM_WORDS:
        yield text
        return
    for k in range(0, len(words) - 2 * least, ITEM_WORDS - 2 * least):
        yield " ".join(words[k : k + ITEM_WORDS])
