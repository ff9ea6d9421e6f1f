import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom.llm.subjects import BITS, Features, Model, Sample, Sections, _fit, _threshold, assign_subjects, best, features, fit_subjects, thresholds

SUBJECTS = ["law", "sea", "sport"]
WORDS = {"law": "statute clause contract judge".split(), "sea": "vessel harbour anchor tide".split(), "sport": "goal referee league striker".split()}
DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, subject string"


def _document(r, subjects, passing):
    plain = lambda: "Nothing turns on the record before us."
    about = lambda s: f"The witness spoke of the {r.choice(WORDS[s])} and the {r.choice(WORDS[s])} at length."
    parts = [about(s) for s in subjects for _ in range(r.randint(2, 3))] + [plain() for _ in range(r.randint(1, 3))]
    parts += [f"{plain()} In passing counsel named a {r.choice(WORDS[p])}." for p in passing]
    r.shuffle(parts)
    style = r.choice(["[{}] ", "({}) ", "§ {} ", "{}. "])
    head = f"Headnote: a {r.choice(WORDS[r.choice(SUBJECTS)])} and a {r.choice(WORDS[r.choice(SUBJECTS)])}.\n"
    return head + "\n".join(style.format(i + 1) + p for i, p in enumerate(parts)) + "\nPage 1 of 2 — X"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    docs, truth = [], {}
    for i in range(900):
        own = r.sample(SUBJECTS, r.choice([0, 1, 1, 2]))
        passing = [s for s in SUBJECTS if s not in own and r.random() < 0.5]
        docs.append((i, _document(r, own, passing)))
        truth[i] = set(own)
    labels = [(i, s) for i in range(600) for s in truth[i] if r.random() > 0.02]
    return docs, truth, labels


def test_held_out_accuracy(spark, corpus):
    docs, truth, labels = corpus
    df = spark.createDataFrame(docs, DOCS).withColumn("subject", F.lit("x"))
    model = fit_subjects(df, spark.createDataFrame(labels, LABELS), SUBJECTS)
    got = {(r.doc_id, r.subject) for r in assign_subjects(df, model).where("doc_id >= 600").collect()}
    want = {(i, s) for i in range(600, 900) for s in truth[i]}
    assert len(got & want) / len(got) > 0.97 and len(got & want) / len(want) > 0.97


def test_features_against_plain_python():
    text = "Before.\r\n[1] <p>One two, ONE</p>\r\nPage 1 of 9 — 00X\r\ntwo\n\nHeadnote: never me.\n\n(2) Solo\n§ 3 12 34\n4. three-\nfold four"
    f = features(pa.array(["nothing numbered", text, None, "", "1. x y"]), Sections(between=None))
    h = lambda w: zlib.crc32(w.encode())
    uni = lambda w: (h(w) ^ (h(w) >> 16)) & ((1 << 18) - 1)

    def bi(a, b):
        x = ((h(a) * 0x9E3779B1) ^ (h(b) * 0x85EBCA77)) & 0xFFFFFFFF
        return (x ^ (x >> 15)) & ((1 << 18) - 1)

    bags = [sorted([*map(uni, w), *(bi(a, b) for a, b in zip(w, w[1:]))]) for w in (["one", "two", "one", "two"], ["solo"], [""], ["threefold", "four"], ["x", "y"])]
    got = [sorted(f.index[a:b].tolist()) for a, b in zip(f.start, f.start[1:])]
    assert got == bags and f.document.tolist() == [1, 1, 1, 1, 4]


def test_texts_without_numbers_and_asides():
    text = "First one.\n\nSecond two.\n  \nThird"
    f = features(pa.array([text, "1. a\n\nb", "Headnote: only me", None]))
    assert f.document.tolist() == [0, 0, 0, 1, 2]
    told = features(pa.array([text, "1. a\nHeadnote: b c\n2. d", "Leitsatz: x\n\n1. y\nHeadnote: z"]), asides=True)
    assert told.document.tolist() == [1, 2, 2] and np.diff(told.start).tolist() == [3, 1, 1]
    own = Sections(paragraph=r"(?m)^## ", aside=r"(?m)^Abstract\b", between=None)
    assert features(pa.array(["Abstract x\n## a b\n## c"]), own).document.tolist() == [0, 0]


def test_thresholds_lean_on_all_subjects():
    tops = np.array([[3.0, 1.0], [2.0, 9.0], [0.0, -4.0], [-1.0, -5.0]])
    labels = np.array([[1, 0], [1, 1], [0, 0], [0, 0]])
    pooled = _threshold(tops.ravel(), labels.ravel())
    assert thresholds(tops, labels, 2.0).tolist() == pytest.approx([(2 * 1.0 + 2 * pooled) / 4, (5.0 + 2 * pooled) / 3])
    assert thresholds(np.zeros((0, 2)), np.zeros((0, 2)), 1.0).tolist() == [0.0, 0.0]


def test_headnotes_label_what_hands_did_not(spark):
    """With few hand labels, headnotes of other documents teach words that no hand-labelled document has."""
    r = random.Random(5)
    words = {s: ["".join(r.choice("abcdefghiklmnoprstuw") for _ in range(7)) for _ in range(60)] for s in SUBJECTS}
    docs, truth = [], {}
    for i in range(1_500):
        s = r.choice([*SUBJECTS, None])
        told = [f"The witness spoke of the {a} and the {b} at length." for a, b in (r.sample(words[s], 2) for _ in range(3))] if s else []
        parts = [*told, *["Nothing turns on the record before us."] * 3]
        r.shuffle(parts)
        head = f"Headnote: where a {r.choice(words[s][:12])} is late and a {r.choice(words[s][:12])} is not.\n" if s else ""
        docs.append((i, head + "\n".join(f"{k + 1}. {p}" for k, p in enumerate(parts))))
        truth[i] = s
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(45) if truth[i]], LABELS)

    def recall(**options):
        got = {(x.doc_id, x.subject) for x in assign_subjects(df, fit_subjects(df, labels, SUBJECTS, **options)).collect() if x.doc_id >= 45}
        want = {(i, truth[i]) for i in range(45, 1_500) if truth[i]}
        return len(got & want) / len(want), len(got & want) / max(1, len(got))

    (with_notes, precise), (without, _) = recall(), recall(max_weak=0)
    assert with_notes > 0.9 and precise > 0.9 and with_notes > without + 0.1, (with_notes, precise, without)


def test_best_and_threshold():
    s = np.array([[1.0], [3.0], [2.0], [5.0]])
    assert best(s, np.array([0, 0, 0, 2]), 3, 2).ravel().tolist() == [2.0, -np.inf, -np.inf]
    assert _threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5
    assert _threshold(np.array([3.0]), np.array([0])) == 0.0


def test_edges(spark, corpus):
    docs, _, labels = corpus
    df = spark.createDataFrame(docs[:200], DOCS)
    none = fit_subjects(df, spark.createDataFrame([], LABELS), SUBJECTS)
    assert assign_subjects(df, none).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert assign_subjects(empty, fit_subjects(empty, spark.createDataFrame(labels, LABELS), SUBJECTS)).count() == 0
    dirty = spark.createDataFrame([*labels[:200], *labels[:50], (None, "law"), (3, None), (4, "unknown"), (10**9, "law")], LABELS)
    model = fit_subjects(df, dirty, SUBJECTS)
    body = "\n".join(f"{i}. The witness spoke of the vessel and the harbour at length." for i in range(1, 4))
    odd = spark.createDataFrame([(1, body), (1, body), (2, None), (3, ""), (None, body), (4, (body + "\n") * 3_000), (5, "vessel harbour")], DOCS)
    assert rows(assign_subjects(odd, model)) == [(1, "sea"), (1, "sea"), (4, "sea")]
    small = fit_subjects(df, dirty, SUBJECTS, max_documents=50)
    assert small.weights.any()
    assert not fit_subjects(df, dirty, SUBJECTS, max_chars=10).weights.any()


def _plain_fit(f, target, rounds, l2):
    """Each round gathers the weights of all entries and counts the gradient entry by entry."""
    count = np.bincount(f.index, minlength=1 << BITS)
    used = np.flatnonzero(count >= 2)
    place = np.zeros(1 << BITS, dtype="int32")
    place[used] = np.arange(len(used))
    often = count[f.index] >= 2
    start = np.concatenate([[0], np.cumsum(often)])[f.start]
    index, size, scale = place[f.index[often]], np.diff(start), np.sqrt(np.maximum(np.diff(f.start), 1))
    w, g2, z = np.zeros(len(used), dtype="float32"), np.full(len(used), 1e-6, dtype="float32"), np.zeros(len(target))
    b = float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    for _ in range(rounds):
        z[size > 0] = np.add.reduceat(w.take(index), start[:-1][size > 0])
        error = 1 / (1 + np.exp(-np.clip(z / scale + b, -30, 30))) - target
        g = np.bincount(index, weights=np.repeat((error / scale).astype("float32"), size), minlength=len(used)) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        b -= 4 * float(error.mean())
    return used, w, b


def _bags(rng, n, most):
    """Rows of 0 to ``most`` entries, a few features in most rows, many in one or two."""
    size = rng.integers(0, most, n)
    start = np.concatenate([[0], np.cumsum(size)])
    index = np.minimum(rng.pareto(0.6, start[-1]) * 20, (1 << BITS) - 1).astype("int32")
    return Features(index, start, np.sort(rng.integers(0, n // 8, n)))


def _rows_of(f, rows):
    return Features(np.concatenate([f.index[a:b] for a, b in zip(f.start[:-1][rows], f.start[1:][rows])]), np.concatenate([[0], np.cumsum(np.diff(f.start)[rows])]), f.document[rows])


def test_fit_is_the_plain_one():
    """Also with rows left out, and with rows that count as if they were not there."""
    rng = np.random.default_rng(4)
    f = _bags(rng, 3_000, 30)
    rows = rng.random(3_000) < 0.8
    target = (rng.random(int(rows.sum())) < 0.3).astype(float)
    out = (rng.random(len(target)) < 0.2) & (target == 0)
    sample = Sample(f, rows)
    for left_out in (None, np.zeros(len(target), dtype=bool), out):
        seen = slice(None) if left_out is None else ~left_out
        used, w, b = _plain_fit(_rows_of(f, np.flatnonzero(rows)[seen]), target[seen], 20, 0.01)
        got = _fit(sample, target, 20, 0.01, out=left_out)
        assert got[0].tolist() == used.tolist() and np.allclose(got[1], w, atol=1e-3) and got[2] == pytest.approx(b, abs=1e-4)
    none = _fit(Sample(f, np.zeros(3_000, dtype=bool)), np.zeros(0), 20, 0.01)
    assert not len(none[0]) and not len(none[1])


def test_fits_of_more_subjects_share_the_layout():
    """A round takes two gathers and two sums, and nothing is laid out anew for a subject: less CPU than the plain fit."""
    rng = np.random.default_rng(5)
    f = _bags(rng, 40_000, 100)
    target = (rng.random(40_000) < 0.1).astype(float)
    sample = Sample(f, np.ones(40_000, dtype=bool))

    def cpu(run):
        took = []
        for _ in range(3):
            t = time.process_time()
            run()
            took.append(time.process_time() - t)
        return min(took)

    assert cpu(lambda: _fit(sample, target, 10, 0.01)) < 0.75 * cpu(lambda: _plain_fit(f, target, 10, 0.01))


def test_scores_are_sums_of_weights():
    rng = np.random.default_rng(6)
    f = _bags(rng, 9_000, 12)
    w = rng.normal(size=(1 << BITS, 3)).astype("float32")
    got = Model(["a", "b", "c"], w, np.array([0.0, 1.0, -1.0]), np.zeros(3)).scores(f)
    for i in (0, 1, 17, 4_095, 4_096, 8_999):
        own = f.index[f.start[i] : f.start[i + 1]]
        assert got[i] == pytest.approx(w[own].astype("float64").sum(axis=0) / np.sqrt(max(len(own), 1)) + [0, 1, -1], abs=1e-9)
