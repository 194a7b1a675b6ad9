import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm.leaks import held, leaks, plain

ITEM = "In 1577 the clerk Kilufu Kozaza of Suloka counted 3534 kindergartens at Naluma, 2879 more than the bailiff Fanivi had entered for 1435. A letter from Rovuda, dated 1641, lists 3842 reading lessons, 4812 mules and the widow Bapozi (Lira, Mona, Tefu) as debtors of Zumabo."
FILL = "The committee heard nobody and ignored them all because the harbour was closed again and again without a word to the district. "


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(item, text, least):
    """Whether a run of the item's words that begins and ends with held words is in the text with at most one error in ten."""
    need = min(least, len(item))
    for i in range(len(item)):
        for j in range(i + need, len(item) + 1):
            run = item[i:j]
            for a in range(len(text)):
                for b in range(a + 1, len(text) + 1):
                    if text[a] == run[0] and text[b - 1] == run[-1] and edit_distance(run, text[a:b]) <= (j - i) // 10:
                        return True
    return False


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=16), st.integers(3, 11))
def test_alignment_as_brute_force(item, text, least):
    mine = held(np.array(item, np.uint64), np.array(text, np.uint64), [], least)
    assert (mine is not None) == brute(item, text, least)


def test_plain():
    assert plain("Überfluss – 12 –\nhal-\nted l'œuvre cafÃ©\nSitting 3 – 14 –\nx").split() == ["uberfluss", "halted", "loeuvre", "cafe", "x"]


def test_passages(spark):
    words = ITEM.split()
    rng = random.Random(2)
    changed = list(words)
    for k in range(5, len(changed), 11):
        changed[k] = "otherwise"
    docs = {
        "whole": FILL + ITEM + " " + FILL,
        "upper": FILL + ITEM.upper().replace(",", " ;"),
        "part": FILL * 30 + " ".join(words[4:26]) + " " + FILL * 30,
        "short": FILL + " ".join(words[4:16]) + " " + FILL,
        "changed": FILL + " ".join(changed) + " " + FILL,
        "shuffled": FILL + " ".join(rng.sample(words, len(words))),
        "interrupted": FILL + " ".join(words[:10]) + " – (Laughter – and cries of “Oh!” from the benches of the left) – " + " ".join(words[10:24]),
        "aside": FILL + " ".join(words[:12]) + " — Gapa Museve (GA): And the fields? — " + " ".join(words[12:24]),
        "broken": FILL + " ".join(words[:22]).replace("kindergartens", "kinder-\ngartens"),
        "same shape": FILL + ITEM.replace("Kilufu", "Bo").replace("Kozaza", "Li").replace("Suloka", "Ma").replace("3534", "1").replace("Naluma", "Po").replace("2879", "2").replace("Fanivi", "Ro").replace("1577", "9").replace("1435", "8").replace("Rovuda", "Z").replace("1641", "3").replace("3842", "4").replace("4812", "5").replace("Bapozi", "Vu").replace("Lira, Mona, Tefu", "A, B, C").replace("Zumabo", "T"),
        "empty": "", "null": None,
    }
    rows = [(k, t, 1, "x") for k, t in enumerate(docs.values())]
    frame = spark.createDataFrame(rows * 2 + [(None, ITEM, 1, "x")], "doc_id long, text string, item_id int, words string")
    items = spark.createDataFrame([(7, ITEM, "s"), (8, "two words", "s"), (9, "", "s"), (10, None, "s"), (None, ITEM, "s"), (7, ITEM, "s")], "item_id long, text string, suite string")
    got = leaks(frame, items).collect()
    names = list(docs)
    assert {names[r.doc_id] for r in got if r.doc_id is not None} == {"whole", "upper", "part", "changed", "interrupted", "aside", "broken"}
    assert {r.item_id for r in got} == {7} and len(got) == 8


def test_short_item_and_long_document(spark):
    docs = spark.createDataFrame([(1, FILL * 800 + "alpha beta gamma delta epsilon zeta eta theta. " + FILL * 800), (2, FILL * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha, beta gamma delta: epsilon zeta eta theta!"), (2, " ".join(f"w{k}" for k in range(3000)))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(1, 1)]
    far = spark.createDataFrame([(5, FILL + " ".join(f"w{k}" for k in range(2000, 2025)))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(far, items).collect()] == [(5, 2)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, items).count() == 0
    assert leaks(docs, spark.createDataFrame([(1, ITEM)], items.schema)).count() == 0


def test_recall_of_candidates_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=60))) for k in range(40)]
    docs, want = [], set()
    for d in range(200):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(5, 300)))
        if d % 2:
            k = rng.randrange(40)
            at = rng.randrange(0, 36)
            passage = items[k][1].split()[at : at + 24]
            for _ in range(2):
                passage[rng.randrange(1, 23)] = "changed"
            text += " " + " ".join(passage) + " " + text
            want.add((d, k))
        docs.append((d, text))
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_items_of_few_words_are_all_found(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=3 + k % 4))) for k in range(120)]
    docs = [(k, " ".join(rng.choices(words, k=60)) + " " + text + " " + " ".join(rng.choices(words, k=60))) for k, text in items]
    found = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k) for k, _ in items} <= found


def test_many_blocks_equal_one(spark, monkeypatch):
    from symgraph.llm import leaks as module

    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=40))) for k in range(30)]
    docs = [(k, " ".join(rng.choices(words, k=80)) + " " + " ".join(items[k % 30][1].split()[5:30]) + " (Hear, hear!) end") for k in range(40)] + [(k, " ".join(rng.choices(words, k=90))) for k in range(100, 140)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leaks(*tables).collect()}
    monkeypatch.setattr(module, "BLOCK", 7)
    assert {tuple(r) for r in leaks(*tables).collect()} == whole and {(r[0], r[1]) for r in whole} == {(k, k % 30) for k in range(40)}
