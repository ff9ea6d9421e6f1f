import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom.llm.leaks import _window, build_index, contains, find_leaks, grams, least_scores, retrieve
from tickloom.llm.text import document_words, slices, squeezed, squeezed_texts, squeezed_words

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, passage string, question string, answer string"


def word(r):
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))


@pytest.fixture(scope="module")
def world():
    r = random.Random(1)
    common = [word(r) for _ in range(40)]
    make = lambda n: [r.choice(common) if r.random() < 0.4 else word(r) for _ in range(n)]
    items = [(i, " ".join(make(r.randint(50, 90))), "who owns " + word(r), word(r)) for i in range(60)]
    return r, make, items


def test_normalisation():
    text = "IN THE COURT\r\nPage 1 of 5 — 00X-1/2\r\n[3] <p>Half-\nfin&nbsp;ished pans cost 211,109 crowns,<br/>don&#39;t\nLANGWICK COURT   00M-1/9   - 3 -\n§ 4 they?</p>\n-- 00M-1/9 / 2 --\n[p. 4] A v B\nEnd."
    assert squeezed(text) == "inthecourthalffinishedpanscost211109crownsdonttheyend"
    assert squeezed_words("Half-finished, '5,000' — pans!") == ["halffinished", "5000", "pans"]


def _naive(words, doc, least, altered):
    """Stretches of equal length, word by word."""
    n, m = len(words), len(doc)
    for a in range(n):
        for b in range(m):
            wrong = 0
            for k in range(min(n - a, m - b)):
                wrong += words[a + k] != doc[b + k]
                if k + 1 >= least and words[a] == doc[b] and words[a + k] == doc[b + k] and wrong <= altered * (k + 1) + 1e-9:
                    return True
    return False


def test_contains_against_word_by_word():
    r = random.Random(4)
    seen = {True: 0, False: 0}
    for _ in range(300):
        words = [word(r) for _ in range(r.randint(8, 40))]
        a = r.randint(0, len(words) - 6)
        quote = words[a : a + r.randint(6, 34)]
        for _ in range(r.randint(0, 4)):
            quote[r.randrange(1, len(quote) - 1)] = "zz" + word(r)[:4]
        doc = [word(r) for _ in range(5)] + quote + [word(r) for _ in range(5)]
        want = _naive(words, doc, 12, 0.1)
        got = contains(words, "".join(doc), 12, 0.1, lambda doc=doc: doc)
        seen[want] += 1
        assert got == want, (words, quote)
    assert min(seen.values()) > 30


def test_window():
    assert _window([0] * 20, 20, 0.1) and not _window([0] * 19, 20, 0.1)
    assert _window([0] * 9 + [1] + [0] * 5 + [1] + [0] * 4, 20, 0.1) and not _window([0] * 9 + [1, 1, 1] + [0] * 8, 20, 0.1)
    assert _window([0] * 10 + [1, 0, 1, 0, 1] + [0] * 15, 20, 0.1)  # 30 words with 3 wrong, though no 20 of them will do
    assert not _window([1] + [0] * 18 + [1], 20, 0.1)


def _plant(r, make, items, n):
    docs, truth = [], set()
    for d in range(n):
        body = [make(r.randint(20, 150))]
        if r.random() < 0.7:
            i = r.randrange(len(items))
            words = items[i][1].split()
            size = r.choice([8, 12, 20, 24, 40])
            a = r.randint(0, len(words) - size)
            quote = words[a : a + size]
            wrong = r.sample(range(1, size - 1), int(size * r.choice([0, 0.05, 0.1, 0.4])))
            for w in wrong:
                quote[w] = r.choice(["████", "[redacted]", word(r)])
            if size >= 20 and len(wrong) <= size * 0.1:
                truth.add((d, items[i][0]))
            k = size // 2
            style = r.randrange(5)
            if style == 0:
                quote = [q.upper() for q in quote]
            elif style == 1:
                quote.insert(k, "\n\n[p. 3] A v B\n\n")
            elif style == 2:
                quote.insert(k, "\n\n§ 12 ")
            elif style == 3:
                quote[k] = quote[k][:2] + "-\n" + quote[k][2:]
            else:
                quote = [q + r.choice(["", ",", ".", "<br/>"]) for q in quote]
            body.append(quote)
        body.append(make(r.randint(20, 150)))
        docs.append((d, " ".join(w for part in body for w in part)))
    return docs, truth


def test_finds_exactly_the_planted(spark, world):
    r, make, items = world
    docs, truth = _plant(r, make, items, 250)
    got = {(x.doc_id, x.item_id) for x in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == truth and len(truth) > 50
    blocks = {(x.doc_id, x.item_id) for x in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), items_per_block=17).collect()}
    assert blocks == truth


def test_streams_equal_single_texts():
    texts = ["Ä <b>x</b> &amp; y", "caf&eacute; &nbsp;no", None, "", "a[redacted]b ███ [7] z", "\u0130stanbul AT&T\r\n[12] 5,000", "x&amp;lt;y"]
    stream, first = squeezed_texts(pa.array(texts))
    assert [stream[a:b].tobytes().decode() for a, b in zip(first, first[1:])] == [squeezed(t or "") for t in texts]
    stream, first = squeezed_texts(pa.array(["zz", *texts]).slice(1, 3))
    assert [stream[a:b].tobytes().decode() for a, b in zip(first, first[1:])] == [squeezed(t or "") for t in texts[:3]]
    batch = pa.record_batch({"text": ["a" * 10] * 7 + [None, "b" * 100]})
    assert [p.num_rows for p in slices(batch, "text", 3, 25)] == [2, 2, 2, 2, 1] and [p.num_rows for p in slices(batch, "text", 4)] == [4, 4, 1]


@pytest.mark.parametrize("n", [4, 5, 8, 12, 16])
def test_grams_tell_apart(n):
    r = np.random.default_rng(3)
    stream = r.integers(97, 100, 4_000).astype("uint8")
    keys = grams(stream, n)
    text = stream.tobytes()
    assert len(keys) == len(text) - n + 1 and len(set(keys.tolist())) == len({text[i : i + n] for i in range(len(keys))})
    assert not len(grams(stream[: n - 1], n))


def test_least_scores_against_all_choices():
    from itertools import combinations

    r = random.Random(2)
    words = [word(r) for _ in range(12)]
    ends = np.cumsum([len(w) for w in words])
    for n, least, altered in ((4, 4, 0.25), (5, 5, 0.4), (4, 6, 0.0)):
        weight = np.array([r.random() for _ in range(ends[-1] - n + 1)])
        lowest = np.inf
        for a in range(len(words)):
            for b in range(a + least, len(words) + 1):
                lo, hi = ends[a] - len(words[a]), ends[b - 1]
                for wrong in combinations(range(a, b), int(altered * (b - a) + 1e-9)):
                    intact = [p for p in range(lo, hi - n + 1) if all(p + n <= ends[w] - len(words[w]) or p >= ends[w] for w in wrong)]
                    lowest = min(lowest, weight[intact].sum())
        assert least_scores(words, weight, n, least, altered) <= lowest + 1e-9
    assert least_scores(words, weight, 4, 13, 0.1) == np.inf


def _noisy(r, words, how):
    """A quotation with all its words in order, written badly."""
    out = " ".join(words)
    if how.startswith("joined"):
        every = int(how[6:])
        out = "".join(w + ("" if i % every == every - 1 else " ") for i, w in enumerate(words))
    elif how == "split":
        out = " ".join(w[: len(w) // 2] + " " + w[len(w) // 2 :] if i % 4 == 0 and len(w) > 2 else w for i, w in enumerate(words))
    elif how == "hyphens":
        out = " ".join(w[:2] + "-\n" + w[2:] if i % 3 == 0 and len(w) > 3 else w for i, w in enumerate(words))
    elif how == "altered":
        wrong = set(r.sample(range(1, len(words) - 1), len(words) // 10))
        out = " ".join(r.choice(["████", "[redacted]", "zq" + word(r)]) if i in wrong else w for i, w in enumerate(words))
    elif how == "put in":
        out = " ".join(w + (" " + "q" * r.randint(1, 60) if i % 12 == 11 else "") for i, w in enumerate(words))
    return out


@pytest.mark.parametrize("least", [20, 50, 80, 100])
def test_retrieval_loses_no_leak(least):
    """Every pair that the exact alignment accepts is retrieved, however the words are spaced or altered, and few others are."""
    r = random.Random(least)
    common = [word(r) for _ in range(40)]
    make = lambda n: [r.choice(common) if r.random() < 0.4 else word(r) for _ in range(n)]
    items = [(i, " ".join(make(least + 30)), "", "") for i in range(40)]
    index = build_index(items, least, 0.1)
    assert not len(index.always)
    for how in ("plain", "joined5", "joined7", "joined10", "joined2", "split", "hyphens", "altered", "put in"):
        texts, planted = [], set()
        for d in range(120):
            i = r.randrange(40)
            a = r.randint(0, 30)
            texts.append(" ".join(make(r.randint(0, 200))) + " " + _noisy(r, items[i][1].split()[a : a + least + r.randint(0, 8)], how) + " " + " ".join(make(r.randint(0, 200))))
            planted.add((d, i))
        stream, first = squeezed_texts(pa.array(texts))
        pairs = {tuple(p) for p in retrieve(index, stream, first).tolist()}
        bodies = [stream[x:y].tobytes().decode() for x, y in zip(first, first[1:])]
        accepted = {(d, i) for d in range(120) for i in range(40) if contains(index.words[i], bodies[d], least, 0.1, lambda d=d: document_words(texts[d]))}
        assert planted <= accepted <= pairs, how
        assert len(pairs) < 3 * len(accepted), how


def test_pruning_leaves_postings_unread(world):
    """Texts of quotations too short to matter from many items: only the runs of blocks that could reach a threshold are opened."""
    r, make, items = world
    snippet = lambda: (w := r.choice(items)[1].split())[(a := r.randint(0, 40)) : a + 3]
    texts = [" ".join(x for _ in range(20) for x in [*snippet(), *make(3)]) + (" " + items[d % 60][1] if d % 10 == 0 else "") for d in range(100)]
    stream, first = squeezed_texts(pa.array(texts))
    read = {}
    pairs = {tuple(p) for p in retrieve(build_index(items, 20, 0.1), stream, first, read).tolist()}
    assert {(d, d % 60) for d in range(0, 100, 10)} <= pairs and len(pairs) < 0.05 * 100 * 60
    assert 0 < read["read"] < 0.6 * read["postings"], read


def test_items_that_keep_no_term(spark):
    """With every third word wrong no term need be left; the leak is found all the same."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(2)) for _ in range(40)]
    index = build_index([(1, " ".join(words), "", "")], 20, 0.5)
    assert index.always.tolist() == [0]
    quote = [w if i % 4 < 2 else "zzzz" for i, w in enumerate(words[:31])]
    docs = spark.createDataFrame([(1, "so it was " + " ".join(quote)), (2, "nothing here")], DOCS)
    found = find_leaks(docs, spark.createDataFrame([(1, " ".join(words), "", "")], ITEMS), altered=0.5)
    assert [x[:2] for x in rows(found)] == [(1, 1)]


def test_long_text_and_far_end(spark, world):
    r, make, items = world
    text = " ".join(make(60_000)) + " " + " ".join(items[5][1].split()[10:40])
    out = find_leaks(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame(items, ITEMS))
    assert [(x.doc_id, x.item_id) for x in out.collect()] == [(1, 5)]


def test_edges(spark, world):
    _, _, items = world
    p = items[0][1]
    tests = spark.createDataFrame([*items[:3], items[0], (None, p, "", ""), (77, None, "", ""), (78, "", "", ""), (79, "too short", None, None)], ITEMS).withColumn("text", F.lit("x"))
    docs = spark.createDataFrame([(1, p), (1, p), (2, ""), (3, None), (None, p), (4, "   "), (5, p + f" {items[0][2]} {items[0][3]}")], DOCS).withColumn("item_id", F.lit(0))
    assert [x[:2] for x in rows(find_leaks(docs, tests))] == [(1, 0), (1, 0), (5, 0)]
    asked = find_leaks(docs, tests).where("doc_id = 5").first()
    assert asked.question_share == 1.0 and asked.answer_found
    assert find_leaks(spark.createDataFrame([], DOCS), tests).count() == 0
    assert find_leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    with pytest.raises(ValueError):
        find_leaks(docs.drop("text"), tests)
