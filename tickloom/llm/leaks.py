"""Evaluation passages inside a corpus.

The test items form a BM25 inverted index. Its terms are runs of bytes of the squeezed text (letters and digits only), to which
spacing, hyphens and line ends make no difference. Every passage of every document (windows that overlap by half and together cover
the whole text) is a query; half a window is longer than any leak that holds no shorter one. Block-max WAND in bulk: items stand in
blocks, the postings of a term in one run per block with an upper bound, and only the runs of blocks whose summed bounds reach the
lowest threshold of their items are opened. An item's threshold is the least score that a leak can have, so retrieval loses none; an
exact alignment of the text against the item decides.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.llm.text import LONGEST, document_words, slices, squeezed, squeezed_texts, squeezed_words
from tickloom.sources.ship import ship

BLOCK = 8
#: Lengths of terms that an index may have, longest first.
GRAMS = (16, 12, 10, 8, 6, 5, 4)
_K1, _B = 1.2, 0.75
_CHUNK = 1 << 21
_FILTER_BITS = 22


@dataclass
class Index:
    """Inverted index of one block of items; arrays only, so that it travels well. The postings of a term stand in runs, one per
    block of items: ``run_start[t]:run_start[t + 1]`` are the runs of term t, ``posting[r]:posting[r + 1]`` the postings of run r."""

    items: np.ndarray  # item ids
    gram: int  # bytes of a term
    window: int  # half of a passage, in bytes of squeezed text
    filter: np.ndarray  # whether any term has these leading bits
    terms: np.ndarray  # sorted keys
    run_start: np.ndarray
    block: np.ndarray  # by run
    bound: np.ndarray  # by run: the largest impact in it
    posting: np.ndarray
    item: np.ndarray  # by posting
    impact: np.ndarray
    threshold: np.ndarray  # by item
    block_threshold: np.ndarray
    always: np.ndarray  # items whose leaks may leave no term intact: every text is a candidate
    words: list  # squeezed words by item
    answers: list
    questions: list


def grams(stream: np.ndarray, n: int) -> np.ndarray:
    """Keys of the ``n`` bytes from each position; up to 8 bytes are told apart exactly."""
    if len(stream) < n:
        return np.empty(0, dtype="uint64")
    packed, size = stream.astype("uint64"), 1
    while size * 2 <= min(n, 8):
        packed = (packed[:-size] << np.uint64(8 * size)) | packed[size:]
        size *= 2
    key = packed[: len(stream) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
    if size < n:
        key = key + (packed[n - size :] ^ (packed[n - size :] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return key ^ (key >> np.uint64(31))


def least_scores(words: list[str], weight: np.ndarray, n: int, least: int, altered: float) -> float:
    """A lower bound of the summed weights of the terms that a leak of these words leaves intact; infinite if there can be no leak.

    ``weight`` is by position of the term. A wrong word breaks the terms that touch it, and no more than the share ``altered`` of a
    stretch is wrong. A stretch twice as long as the shortest has a half that is a leak itself, so shorter ones suffice; among those
    with as many wrong words the shortest leaves least.
    """
    m = len(words)
    if m < least:
        return np.inf
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    at = lambda p: upto[np.clip(p, 0, len(weight))]
    broken = at(ends) - at(starts - n + 1)
    out = np.inf
    for size in stretch_lengths(least, altered):
        if size > m:
            break
        k = int(altered * size + 1e-9)
        whole = np.maximum(at(ends[size - 1 :] - n + 1) - at(starts[: m - size + 1]), 0)
        if k:
            inside = np.lib.stride_tricks.sliding_window_view(broken, size)
            whole = whole - (np.partition(inside, size - k, axis=1)[:, size - k :].sum(axis=1) if k < size else inside.sum(axis=1))
        out = min(out, float(whole.min()))
    return out


def stretch_lengths(least: int, altered: float) -> list[int]:
    """``least`` and the shortest longer stretches, below twice as long, that may have one more wrong word than a shorter one."""
    wrong = lambda m: int(altered * m + 1e-9)
    return [least, *(m for m in range(least + 1, 2 * least) if wrong(m) > wrong(m - 1))]


def build_index(rows: list[tuple], least: int, altered: float, gram: int | None = None) -> Index:
    """rows: (id, passage, question, answer) with text in the passage.

    Terms are as long as they can be while every leak keeps at least 15 of 100 terms of its stretch, or as short as ``GRAMS`` has them; items of which a leak may keep none even so are listed in ``always``."""
    n_items = len(rows)
    words = [squeezed_words(r[1]) for r in rows]
    streams = [np.frombuffer("".join(w).encode(), dtype="uint8") for w in words]
    shares = lambda n: [least_scores(w, np.ones(max(0, len(s) - n + 1)), n, least, altered) / max(1, _longest(w, least)) for w, s in zip(words, streams)]
    gram = gram or next((n for n in GRAMS if min(shares(n), default=1.0) >= 0.15), GRAMS[-1])
    keys = [grams(s, gram) for s in streams]
    flat = np.concatenate([*keys, np.empty(0, dtype="uint64")])
    terms, term = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n_items), [len(k) for k in keys])
    pair, inverse, tf = np.unique(term.ravel() * max(1, n_items) + owner, return_inverse=True, return_counts=True)  # by term, then item
    term_of, item = pair // max(1, n_items), pair % max(1, n_items)
    df = np.bincount(term_of, minlength=len(terms))
    length = np.bincount(owner, minlength=n_items).astype(float)
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    norm = _K1 * (1 - _B + _B * length / max(length.mean() if n_items else 1, 1))
    impact = idf[term_of] * tf * (_K1 + 1) / (tf + norm[item])
    # A term that an item has more than once scores once, so its places share the impact.
    shared = (impact / tf)[inverse.ravel()]
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(int)
    threshold = np.array([least_scores(w, shared[a:b], gram, least, altered) for w, a, b in zip(words, cuts, cuts[1:])])
    always = np.flatnonzero(threshold <= 0)
    threshold = np.where(threshold > 0, threshold * (1 - 1e-9), np.inf)
    block = item // BLOCK
    run_key, run_at = np.unique(term_of * (n_items // BLOCK + 1) + block, return_index=True)
    run_term = run_key // (n_items // BLOCK + 1)
    block_threshold = np.full(-(-n_items // BLOCK), np.inf)
    np.minimum.at(block_threshold, np.arange(n_items) // BLOCK, threshold)
    longest = max((_longest(w, 2 * least - 1) for w in words), default=0)
    known = np.zeros(1 << _FILTER_BITS, dtype=bool)
    known[(terms >> np.uint64(64 - _FILTER_BITS)).astype("int64")] = True
    return Index(
        np.array([r[0] for r in rows], dtype="int64"), gram, longest + LONGEST * int(altered * (2 * least - 1) + 1), known, terms,
        np.searchsorted(run_term, np.arange(len(terms) + 1)), run_key % (n_items // BLOCK + 1), np.maximum.reduceat(impact, run_at) if len(run_at) else np.empty(0),
        np.concatenate([run_at, [len(item)]]), item, impact, threshold, block_threshold, always, words, [squeezed(r[3] or "") for r in rows], [squeezed_words(r[2] or "") for r in rows],
    )


def _longest(words: list[str], size: int) -> int:
    """Bytes of the longest stretch of ``size`` words."""
    upto = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    return int(upto[-1]) if len(words) <= size else int((upto[size:] - upto[:-size]).max())


def _expand(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[r]:start[r + 1] of the given rows one after the other, and which of the given rows each is of."""
    n = start[rows + 1] - start[rows]
    which = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return start[rows][which] + inner, which


def _hits(index: Index, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the texts that the index knows: term, position in the stream, text number."""
    found, places = [], []
    for lo in range(0, max(0, len(stream) - index.gram + 1), _CHUNK):
        keys = grams(stream[lo : lo + _CHUNK + index.gram - 1], index.gram)
        maybe = np.flatnonzero(index.filter[(keys >> np.uint64(64 - _FILTER_BITS)).view("int64")])
        keys = keys[maybe]
        term = np.searchsorted(index.terms, keys)
        term[term == len(index.terms)] = 0
        hit = index.terms[term] == keys if len(index.terms) else np.zeros(0, dtype=bool)
        found.append(term[hit])
        places.append(lo + maybe[hit])
    none = np.empty(0, dtype="int64")
    term, at = np.concatenate([none, *found]), np.concatenate([none, *places])
    text = np.searchsorted(first, at, side="right") - 1
    whole = at + index.gram <= first[text + 1] if len(at) else np.zeros(0, dtype=bool)  # a term does not run on into the next text
    return term[whole], at[whole], text[whole]


def retrieve(index: Index, stream: np.ndarray, first: np.ndarray, read: dict | None = None) -> np.ndarray:
    """Pairs (text number, item number) above the item's threshold in some passage, as a sorted n x 2 array. ``read`` is told the
    number of ``postings`` of the terms asked for and of those ``read``."""
    n_items, n_blocks = len(index.items), len(index.block_threshold)
    texts = np.arange(len(first) - 1)
    every = np.stack([np.repeat(texts, len(index.always)), np.tile(index.always, len(texts))], axis=1)
    term, at, text = _hits(index, stream, first)
    if not len(term):
        return every
    step = (at - first[text]) // index.window
    # A place lies in the passage that begins in its half-passage and in the one before; passages are numbered over the batch.
    per_text = np.diff(first) // index.window + 2
    base = np.cumsum(per_text) - per_text
    passage = np.concatenate([base[text] + step, (base[text] + step - 1)[step > 0]])
    term = np.concatenate([term, term[step > 0]])
    query = np.unique(passage * len(index.terms) + term)  # a passage asks each term once
    passage, term = query // len(index.terms), query % len(index.terms)
    run, which = _expand(index.run_start, term)
    cell = passage[which] * n_blocks + index.block[run]
    cells, inverse = np.unique(cell, return_inverse=True)
    upper = np.bincount(inverse.ravel(), weights=index.bound[run])
    alive = (upper >= index.block_threshold[cells % n_blocks])[inverse.ravel()]
    live, asker = run[alive], passage[which][alive]
    row, which = _expand(index.posting, live)  # only the runs of live blocks are opened
    if read is not None:
        size = np.diff(index.posting)
        read["postings"] = read.get("postings", 0) + int(size[run].sum())
        read["read"] = read.get("read", 0) + len(row)
    pair, inverse = np.unique(asker[which] * n_items + index.item[row], return_inverse=True)
    score = np.bincount(inverse.ravel(), weights=index.impact[row], minlength=len(pair))
    pair = pair[score >= index.threshold[pair % n_items]] if len(pair) else pair
    text = np.searchsorted(base, pair // n_items, side="right") - 1
    return np.unique(np.concatenate([every, np.stack([text, pair % n_items], axis=1)]), axis=0)


def _after(words: list[str], text: str, j: int, o: int, step: int) -> list[tuple[int, int]]:
    """Alignment from word j, which stands at o, in one direction: (word, cost) with cost 0 for a match."""
    out: list[tuple[int, int]] = []
    n = len(words)
    while True:
        nxt = j + step
        if not 0 <= nxt < n:
            return out
        here = o + len(words[j]) if step > 0 else o - len(words[nxt])
        if here >= 0 and text.startswith(words[nxt], here):
            out.append((nxt, 0))
            j, o = nxt, here
            continue
        best = None
        for skip in range(4):  # words altered, blacked out or, with none, something put in between
            a = j + (skip + 1) * step
            b = a + step
            if not (0 <= a < n and 0 <= b < n):
                continue
            pair = words[a] + words[b] if step > 0 else words[b] + words[a]
            reach = 14 * skip + 24
            if step > 0:
                edge = o + len(words[j])
                p = text.find(pair, edge, edge + reach + len(pair))
                if p < 0:
                    continue
                gap, spot = p - edge, p
            else:
                p = text.rfind(pair, max(0, o - reach - len(pair)), o)
                if p < 0:
                    continue
                gap, spot = o - p - len(pair), p + len(words[b])
            cost = max(skip, 1, -(-gap // 12))
            if best is None or (cost, gap) < best[:2]:
                best = (cost, gap, a, spot)
        if best is None:
            return out
        cost, _, a, spot = best
        between = list(range(j + step, a, step))
        if between:
            out += [(w, 1) for w in between]
            out[-1] = (between[-1], 1 + cost - len(between))
            out.append((a, 0))
        else:
            out.append((a, cost))
        j, o = a, spot


def contains(words: list[str], body: str, least: int, altered: float, doc_words: Callable[[], list[str]] | None = None) -> bool:
    """Whether a document holds at least ``least`` successive words of an item, at most the share ``altered`` of them wrong; the
    stretch begins and ends with right words. ``body`` is the document squeezed, ``doc_words`` gives its words.

    Three steps: words that stand nowhere in the text rule most candidates out; a straight alignment of the squeezed text, to which
    spacing makes no difference, lets most leaks in; what is left is decided by an alignment of the words that is exact.
    """
    if not _window([0 if w in body else 1 for w in words], least, altered):
        return False
    done = set()
    for j in range(len(words) - 2):
        seed = words[j] + words[j + 1] + words[j + 2]
        o = body.find(seed)
        while o >= 0:
            if (j, o) not in done:
                back, ahead = _after(words, body, j, o, -1), _after(words, body, j, o, 1)
                spot = o
                for k in range(j, len(words) - 2):  # seeds along the same straight stretch
                    if not body.startswith(words[k], spot):
                        break
                    done.add((k, spot))
                    spot += len(words[k])
                if _window([c for _, c in [*back[::-1], (j, 0), *ahead]], least, altered):
                    return True
            o = body.find(seed, o + 1)
    return doc_words is not None and _aligned(words, doc_words(), least, altered)


def _aligned(words: list[str], doc: list[str], least: int, altered: float) -> bool:
    """Exact: the best alignment over all pairs of stretches. An item word gains ``altered`` and costs 1 if it is changed or
    missing, a word put in between costs 1; a stretch of ``least`` words with a score of at least 0 is a leak."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    a, d = np.array([number[w] for w in words]), np.array([number.get(w, -1) for w in doc])
    if len(a) < least or not len(d):
        return False
    pairs = np.unique(a[:-1] * len(number) + a[1:])
    seeds = np.flatnonzero((d[:-1] >= 0) & (d[1:] >= 0) & np.isin(d[:-1] * len(number) + d[1:], pairs))
    if not len(seeds):
        return False
    cuts = np.flatnonzero(np.diff(seeds) > 2 * least) + 1  # a stretch has no longer way without two right words in a row
    for part in np.split(seeds, cuts):
        if _best(a, d[max(0, part[0] - least) : part[-1] + least + 2], least, altered):
            return True
    return False


def _best(a: np.ndarray, d: np.ndarray, least: int, altered: float) -> bool:
    n, m = len(a), len(d)
    place = np.arange(m + 1)
    score = np.empty((0, m + 1))  # by first word of the stretch and by words of the document used
    first = np.empty(0, dtype=int)
    for i in range(n):
        right = np.concatenate([[False], d == a[i]])
        if len(first):
            moved = np.concatenate([np.full((len(first), 1), -np.inf), score[:, :-1]], axis=1)
            matched = np.where(right, moved + altered, -np.inf)
            if (matched[first <= i - least + 1] >= -1e-9).any():
                return True
            score = np.maximum(np.maximum(matched, moved + altered - 1), score + altered - 1)
        score = np.concatenate([score, np.where(right, altered, -np.inf)[None]])
        first = np.append(first, i)
        score = np.maximum.accumulate(score + place, axis=1) - place  # words put in between
        alive = score.max(axis=1) + altered * (n - 1 - i) >= -1e-9
        score, first = score[alive], first[alive]
    return False


def _window(costs: list[float], least: int, altered: float) -> bool:
    """Whether a stretch of at least ``least`` has a mean cost of at most ``altered`` and no cost at its ends."""
    value, lowest = [0.0], np.inf
    for c in costs:
        value.append(value[-1] + altered - c)
    for b in range(least, len(costs) + 1):
        a = b - least
        if not costs[a]:
            lowest = min(lowest, value[a])
        if not costs[b - 1] and value[b] - lowest >= -1e-9:
            return True
    return False


_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("question_share", pa.float64()), ("answer_found", pa.bool_())])


def find_leaks(corpus: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", question: str = "question", answer: str = "answer", least: int = 20, altered: float = 0.1, items_per_block: int = 20_000) -> DataFrame:
    """Documents that hold at least ``least`` successive words of an item's passage, in order, of which at most the share
    ``altered`` is changed or blacked out.

    Columns out: ``doc_id``, ``item_id``, ``question_share`` (share of the question's words in the document), ``answer_found``; one
    row per pair and copy of the document. Letter case, punctuation, spacing, line ends, hyphens, markup, page headers and numbers
    of paragraphs make no difference. Null ids, texts and passages and empty texts give no rows; of repeated items one counts;
    items shorter than ``least`` words cannot be found. Extra columns are ignored. Beyond some 0.3 ``altered`` a leak may keep no term of
    an item; such items are aligned with every text, which is slow but exact.

    Corpus rows are read once per block of ``items_per_block`` items (one block for any usual test set) and are not shuffled. The
    index of a block, whose size the parameter bounds, is broadcast.
    """
    require(corpus, id_column, text)
    require(items, item_id, passage, question, answer)
    spark = corpus.sparkSession
    ship(spark)
    docs = corpus.where(col(id_column).isNotNull() & (F.length(col(text)) > 0)).select(col(id_column).cast("long").alias("doc_id"), col(text).alias("text"))
    tests = items.where(col(item_id).isNotNull() & (F.length(col(passage)) > 0)).select(col(item_id).cast("long").alias("i"), col(passage).alias("p"), col(question).alias("q"), col(answer).alias("a"))
    tests = tests.groupBy("i").agg(F.max(F.struct("p", "q", "a")).alias("x")).select("i", "x.*")
    blocks = max(1, -(-tests.count() // items_per_block))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").collect()]  # items_per_block or so
        shared = spark.sparkContext.broadcast(pickle.dumps(build_index(rows, least, altered)))
        part = docs.mapInArrow(_search(shared, least, altered), "doc_id long, item_id long, question_share double, answer_found boolean")
        out = part if out is None else out.unionByName(part)
    return out


def _search(shared, least: int, altered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index | None = None
        for batch in batches:
            if index is None:
                index = pickle.loads(shared.value)
            for part in slices(batch, "text", 1_000):
                texts, ids = part.column("text"), part.column("doc_id")
                stream, first = squeezed_texts(texts)
                found = []
                last, body, words = None, "", None
                for t, i in retrieve(index, stream, first):
                    if t != last:
                        last, body = t, stream[first[t] : first[t + 1]].tobytes().decode()
                        words = cache(lambda t=int(t), texts=texts: document_words(texts[t].as_py()))
                    if contains(index.words[i], body, least, altered, words):
                        q = index.questions[i]
                        found.append((ids[int(t)].as_py(), int(index.items[i]), sum(w in body for w in q) / len(q) if q else None, bool(index.answers[i]) and index.answers[i] in body))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), _RESULT)], schema=_RESULT)

    return run
