import random

import numpy as np
import pyarrow as pa
import pytest

from symgraph.llm import subjects
from symgraph.llm.subjects import GROUPS, MOST_SUBJECTS, Part, Terms, featured, parts, subject_shares

NOUNS = {
    "health": ["nurses", "hospital wards", "vaccines", "midwives", "surgeons"], "transport": ["bridges", "ferry routes", "tunnels", "bus drivers", "runways"], "law": ["juries", "bail hearings", "prosecutors", "statutes", "verdicts"],
}
FRAMES = ["I welcome the plan for {}, though it comes late.", "Who pays for the {} when the money is gone?", "Nobody in this chamber doubts that {} matter.", "The committee heard 12 experts on {} and ignored them all.", "My party wants {} that deserve the name."]
EMPTY = ["I shall be brief.", "Allow me to finish.", "We have heard this before.", "That is the heart of the matter."]
CHAIR = ["Order. The sitting is resumed.", "The question is that the amendment be made.", "I think the Ayes have it. The Ayes have it.", "The debate stood adjourned."]
DOCS = "doc_id long, text string, speaker_id long, share double, subject string"


def corpus(n=300):
    rng = random.Random(8)
    rows, truth = [], {}
    for d in range(n):
        if d % 10 == 0:
            rows.append((d, " ".join(rng.choices(CHAIR, k=5)), 1, 0.0, ""))
            truth[d] = set()
            continue
        areas = rng.sample(list(NOUNS), 1 if d % 3 else 2)
        parts = [rng.choice(FRAMES).format(rng.choice(NOUNS[areas[k % len(areas)]])) for k in range(8)] + rng.choices(EMPTY, k=3)
        rng.shuffle(parts)
        other = next(a for a in NOUNS if a not in areas)
        parts.insert(4, f"(Cries of: what about the {NOUNS[other][0]}?) [HON. MEMBERS: Withdraw!]")
        rows.append((d, " ".join(parts), 2 + d % 40, 0.0, ""))
        truth[d] = set(areas)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    rng = random.Random(1)
    labelled = [d for d in truth if truth[d] and d % 4 == 1]
    labels = [(d, s) for d in labelled for s in truth[d]]
    labels = [(d, rng.choice(list(NOUNS))) if rng.random() < 0.08 else (d, s) for d, s in labels] + labels[:5] + [(99_999, "health"), (1, None), (None, "law"), (3, "cookery")]
    docs = spark.createDataFrame(rows + rows[:20] + [(None, "x", 1, 0.0, ""), (1000, None, 5, 0.0, ""), (1001, "", 5, 0.0, "")], DOCS)
    areas = spark.createDataFrame([(s, "", 1) for s in NOUNS], "subject string, description string, n int")
    found = subject_shares(docs, spark.createDataFrame(labels, "doc_id long, subject string"), areas).filter("share >= 0.25").collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [d for d in truth if d not in labelled]
    right = sum(got.get(d, set()) == truth[d] for d in held_out)
    assert right / len(held_out) >= 0.97
    assert all(d not in got for d in truth if d % 10 == 0) and 1000 not in got and 1001 not in got
    assert len(found) == len({(r.doc_id, r.subject) for r in found})


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, subject string")
    subjects = spark.createDataFrame([], "subject string, description string")
    assert subject_shares(docs, labels, subjects).count() == 0
    some = spark.createDataFrame([("health", None)], subjects.schema)
    assert subject_shares(docs, labels, some).count() == 0
    assert subject_shares(docs.drop("speaker_id"), labels, some).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "The nurses wait. " * 20_000, None, 0.0, "")], DOCS)
    labels = spark.createDataFrame([(1, "health")], "doc_id long, subject string")
    subjects = spark.createDataFrame([("health", "nurses"), ("law", "courts")], "subject string, description string")
    assert subject_shares(docs, labels, subjects).count() <= 2


def test_sentences():
    text = "Mr. Speaker, Dr. A. Bo is right. – (Laughter) – We know.\nSitting 3 – 14 –\nThe next item is Motion on Fields. It is well-\nknown!"
    group, found, formulas = Terms().of(text)
    assert group == 0 and [len(s) for s in found] == [6, 2, 7, 3] and formulas == [False, False, True, False]
    assert Terms().of("") == (GROUPS - 1, [], []) and Terms().of("\0 \1 ...")[1] == []


def test_rank_is_truncated_and_matters(spark):
    rows, truth = corpus(200)
    labels = spark.createDataFrame([(d, s) for d in truth if d % 2 for s in truth[d]], "doc_id long, subject string")
    table, vocabulary = featured(spark.createDataFrame(rows, DOCS), labels, sorted(NOUNS))
    weights = np.ones(len(vocabulary.terms))
    axes = np.linalg.qr(np.random.default_rng(1).standard_normal((len(weights), 8)))[0]
    for _ in range(12):
        axes = subjects._stepped(table, weights, axes)
    dense = np.zeros((200, len(weights)))
    for r in table.orderBy("doc_id").collect():
        np.add.at(dense[r.doc_id], r.terms, 1)
    dense = np.log1p(dense)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    exact = np.linalg.svd(dense, full_matrices=False)[2][:8]
    assert axes.shape[1] == 8 < len(weights)
    assert np.linalg.norm(dense @ axes) ** 2 >= 0.99 * np.linalg.norm(dense @ exact.T) ** 2
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-6


def test_parts_keep_all_rows_at_any_size():
    n = 50
    lists = lambda kind, rows: pa.array(rows, pa.list_(kind))
    rng = random.Random(5)
    sizes = [[rng.randint(1, 4) for _ in range(rng.randint(0, 5))] for _ in range(n)]
    terms = [[rng.randrange(30) for _ in range(sum(s))] for s in sizes]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([k % GROUPS for k in range(n)], pa.int8()), lists(pa.int32(), sizes), lists(pa.int32(), terms), lists(pa.bool_(), [[False] * len(s) for s in sizes])],
        ["doc_id", "lang", "sizes", "terms", "formulas"],
    )
    vectors = np.random.default_rng(2).standard_normal((30, 4)).astype(np.float32)
    whole = Part(batch).sums(vectors)
    for most in (1, 7, 10_000):
        cut = list(parts(iter([batch]), most))
        assert np.concatenate([b.column("doc_id").to_numpy() for _, b in cut]).tolist() == list(range(n))
        assert np.allclose(np.concatenate([p.sums(vectors) for p, _ in cut]), whole, atol=1e-5)


def test_too_many_subjects_are_refused(spark):
    some = spark.createDataFrame([(f"s{k}", "x") for k in range(MOST_SUBJECTS + 1)], "subject string, description string")
    with pytest.raises(ValueError, match="subjects"):
        subject_shares(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, subject string"), some)


def test_an_ordinary_speaker_of_a_third_of_the_rows_changes_nothing(spark):
    rows, truth = corpus()
    labels = spark.createDataFrame([(d, s) for d in truth if d % 2 for s in truth[d]], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, "") for s in NOUNS], "subject string, description string")
    found = [
        {(r.doc_id, r.subject) for r in subject_shares(spark.createDataFrame([(r[0], r[1], 2 if one and r[0] % 3 else r[2], *r[3:]) for r in rows], DOCS), labels, areas).collect()}
        for one in (False, True)
    ]
    assert found[0] == found[1] and len(found[0]) > 250


def test_own_sentences_count_though_an_item_has_some_of_their_words(spark, tmp_path):
    from symgraph.llm.queries import p8_shares

    rows, truth = corpus(200)
    rows.append((999, "Who pays for the bail hearings when the money is gone?", 5, 0.0, ""))
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "doc_labels": spark.createDataFrame([(d, s) for d in truth if d % 2 for s in truth[d]], "doc_id long, subject string"),
        "subjects": spark.createDataFrame([(s, "") for s in NOUNS], "subject string, description string"),
        "eval_items": spark.createDataFrame([(1, "It is said of him who pays for the ferry to Vusofo that he sails when the money is gone and no wind blows.")], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    found = [(r.subject, r.n_sentences) for r in p8_shares(spark, str(tmp_path)).filter("doc_id = 999").collect()]
    assert found == [("law", 1)]
