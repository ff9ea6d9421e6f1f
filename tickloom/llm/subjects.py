"""Subjects of documents: one-versus-rest linear classifiers over hashed word n-grams of paragraphs.

Weak labels come from section metadata: a classifier of headnotes, fitted against the hand labels, labels documents that have none.
Labels say which subjects a document has, not which paragraphs make them so; a paragraph starts with its document's labels. After
each fit a paragraph keeps a label only if its own score supports it, except that the best ``needed`` paragraphs of a labelled
document always keep theirs, and the classifiers are fitted again. Headnotes are no paragraphs: they never make a subject. A
document has a subject if its ``needed``-th best paragraph reaches the subject's threshold, which is calibrated, for the weights that
are used, on hand-labelled documents held out from all fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.llm.text import NUMBER, slices, sub, without_pages
from tickloom.sources.ship import ship
from tickloom.sources.tables import stored

BITS = 18
NEEDED = 2
_MASK = (1 << BITS) - 1
# Fixed value: opening of a headnote, in the corpus's languages.
HEADNOTE = r"(?m)^[ \t]*(?:<p>)?[ \t]*(?:Headnote|Leitsatz)\b"


@dataclass(frozen=True)
class Sections:
    """How texts fall into sections, as RE2 patterns: ``paragraph`` and ``aside`` match the openings of paragraphs and of sections that
    only tell of the document. ``between`` separates the paragraphs of a text without any opening; None: such a text has none.
    ``clean`` takes out what stands in the midst of sections."""

    paragraph: str = NUMBER
    aside: str = HEADNOTE
    between: str | None = r"\n[ \t]*\n"
    clean: Callable[[pa.Array], pa.Array] = without_pages


@dataclass
class Features:
    """Paragraphs as bags of hashed unigrams and bigrams: row p has index[start[p]:start[p + 1]]; document of each paragraph."""

    index: np.ndarray
    start: np.ndarray
    document: np.ndarray


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    table = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], dtype="uint32")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (table[codes] if len(table) else np.empty(0, dtype="uint32")), codes


def features(texts: pa.Array, sections: Sections = Sections(), *, asides: bool = False) -> Features:
    """Paragraphs of each text, or its asides. Null and empty texts have none."""
    t = sub(sections.clean(texts), sections.paragraph, "\x01\x03")
    t = sub(t, sections.aside, "\x01\x02")
    if sections.between is not None and not asides:
        bare = pc.invert(pc.fill_null(pc.match_substring(t, "\x01\x03"), True))
        if pc.any(bare).as_py():
            t = pc.if_else(bare, sub(pc.binary_join_element_wise("\x01\x03", t, ""), sections.between, "\x01\x03"), t)
    t = sub(t, r"&(?:nbsp|#160);|<[^<>\n]{1,40}>", " ")
    t = sub(t, r"[-‐‑\x{AD}]\s*\n\s*", "")
    parts = pc.split_pattern(t, "\x01")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    wanted = pc.starts_with(flat, "\x02" if asides else "\x03")
    owner, flat = owner[wanted.to_numpy(zero_copy_only=False)], flat.filter(wanted)
    plain = pc.utf8_trim_whitespace(sub(pc.utf8_lower(flat), r"[^\p{L} ]+", " "))
    lists = pc.ascii_split_whitespace(plain)  # letters and blanks are left
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    hashes, _ = _hashes(lists.flatten())
    n = len(hashes)
    if not n:
        return Features(np.empty(0, dtype="int32"), np.zeros(len(owner) + 1, dtype="int64"), owner)
    with np.errstate(over="ignore"):
        pair = (hashes[:-1] * np.uint32(0x9E3779B1)) ^ (hashes[1:] * np.uint32(0x85EBCA77)) if n > 1 else np.empty(0, dtype="uint32")
        pair = pair ^ (pair >> np.uint32(15))
    ends = np.cumsum(lengths)
    inside = np.ones(n, dtype=bool)
    inside[ends[lengths > 0] - 1] = False  # the last word of a paragraph begins no bigram
    # Word i contributes its unigram and, unless it is the last, the bigram with the next: two slots a word, unused ones dropped.
    both = np.empty((n, 2), dtype="int32")
    both[:, 0] = ((hashes ^ (hashes >> np.uint32(16))) & _MASK).astype("int32")
    both[:-1, 1] = (pair & _MASK).astype("int32")
    used = np.ones((n, 2), dtype=bool)
    used[:, 1] = inside
    counts = 2 * lengths - (lengths > 0)
    return Features(both[used], np.concatenate([[0], np.cumsum(counts)]), owner)


def _row_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of values[start[i]:start[i + 1]], empty rows 0; the rows hold all values."""
    out = np.zeros(len(start) - 1)
    has = start[1:] > start[:-1]
    if has.any():
        out[has] = np.add.reduceat(values, start[:-1][has], dtype="float64")
    return out


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # features x subjects, float32
    bias: np.ndarray
    thresholds: np.ndarray
    needed: int = NEEDED
    sections: Sections = Sections()

    @cached_property
    def _by_subject(self) -> np.ndarray:
        """One row of weights per subject, small enough for a processor's cache."""
        return np.ascontiguousarray(self.weights.T)

    def scores(self, f: Features) -> np.ndarray:
        out = np.empty((len(f.document), len(self.subjects)))
        for lo in range(0, len(f.document), 4_096):
            hi = min(lo + 4_096, len(f.document))
            a, b = f.start[lo], f.start[hi]
            index, start = f.index[a:b].astype(np.intp), f.start[lo : hi + 1] - a
            for j, w in enumerate(self._by_subject):
                out[lo:hi, j] = _row_sums(w.take(index), start)
        return out / _scale(f)[:, None] + self.bias

    def assign(self, f: Features, n: int) -> np.ndarray:
        return best(self.scores(f), f.document, n, self.needed) >= self.thresholds


def _scale(f: Features) -> np.ndarray:
    """Rows are scaled by the root of their length, so that long paragraphs do not outweigh."""
    return np.sqrt(np.maximum(np.diff(f.start), 1))


def best(scores: np.ndarray, document: np.ndarray, n: int, needed: int) -> np.ndarray:
    """The needed-th best score of each document and subject, minus infinity with fewer paragraphs. ``document`` is in order."""
    out = np.full((n, scores.shape[1]), -np.inf)
    if not len(document):
        return out
    count = np.bincount(document, minlength=n)
    has = count >= needed
    rows = has[document]
    owner = np.repeat(np.arange(int(has.sum())), count[has])
    if not len(owner):
        return out
    first = np.cumsum(count[has]) - count[has]
    for k in range(scores.shape[1]):
        s = scores[rows, k]
        for _ in range(needed - 1):  # the best paragraph of each document goes, the first of equal ones
            top = np.flatnonzero(s == np.maximum.reduceat(s, first)[owner])
            s[top[np.diff(owner[top], prepend=-1) > 0]] = -np.inf
        out[has, k] = np.maximum.reduceat(s, first)
    return out


def _by_feature(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each entry, in the order of the features and in these of the rows."""
    low = np.argsort((f.index & 0xFFFF).astype("uint16"), kind="stable")  # two sorts of 16 bits, by radix
    order = low[np.argsort((f.index >> 16).astype("uint16")[low], kind="stable")]
    return np.repeat(np.arange(len(f.document), dtype="int32"), np.diff(f.start))[order], f.index[order]


class Sample:
    """Paragraphs ``rows`` of ``f``, laid out for fits: the entries of features that they have at least twice, once in the order of the
    paragraphs and once in that of the features, so that a round of a fit is two gathers and two sums of neighbours. ``order`` is
    the order of the features where it is known."""

    def __init__(self, f: Features, rows: np.ndarray, order: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.rows, self.part = rows, _take(f, rows)
        part = self.part
        self.count = np.bincount(part.index, minlength=1 << BITS)
        self.used = np.flatnonzero(self.count >= 2)
        place = np.zeros(1 << BITS, dtype=np.intp)
        place[self.used] = np.arange(len(self.used))
        often = self.count[part.index] >= 2
        start = np.concatenate([[0], np.cumsum(often)])[part.start]
        self.index = place[part.index[often]]
        self.scale, self.has = _scale(part), np.diff(start) > 0
        self.heads = start[:-1][self.has]
        row, feature = order or _by_feature(f)
        chosen = rows[row] & (self.count[feature] >= 2)
        self.row = (np.cumsum(rows) - 1)[row[chosen]]
        self.first = np.cumsum(self.count[self.used]) - self.count[self.used]


def _fit(sample: Sample, target: np.ndarray, rounds: int, l2: float, rate: float = 0.5, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch Adagrad over the features that the sample has at least twice: features, weights, bias.
    Paragraphs ``out`` count as if the sample did not have them; their targets are 0."""
    n, live = len(target), None
    if out is not None and out.any():
        n -= int(out.sum())
        live = (sample.count - np.bincount(_take(sample.part, out).index, minlength=1 << BITS))[sample.used] >= 2
    w = np.zeros(len(sample.used), dtype="float32")
    share = float(target.sum()) / n if n else 0.0
    b = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    g2 = np.full_like(w, 1e-6)
    z = np.zeros(len(target))
    for _ in range(rounds if n else 0):
        if len(sample.heads):
            z[sample.has] = np.add.reduceat(w.take(sample.index), sample.heads)
        error = 1 / (1 + np.exp(-np.clip(z / sample.scale + b, -30, 30))) - target
        if live is not None:
            error[out] = 0
        if len(w):
            g = np.add.reduceat((error / sample.scale).astype("float32").take(sample.row), sample.first) + l2 * w
            if live is not None:
                g[~live] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
        b -= 4 * float(error.sum()) / n
    return (sample.used, w, b) if live is None else (sample.used[live], w[live], b)


def _scores(f: Features, used: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    full = np.zeros(1 << BITS, dtype="float32")
    full[used] = w
    return _row_sums(full.take(f.index), f.start) / _scale(f) + b


def _kth(scores: np.ndarray, document: np.ndarray, n: int, needed: int) -> np.ndarray:
    return best(scores[:, None], document, n, needed)[:, 0]


@dataclass
class Training:
    """Paragraphs and asides of the sampled documents, and which of these have no hand labels (``weak``) or are held out. What the fits
    of all subjects share is laid out once by each worker."""

    paragraphs: Features
    asides: Features
    weak: np.ndarray
    held: np.ndarray

    @cached_property
    def samples(self) -> tuple[Sample, Sample, Sample, Sample]:
        """Paragraphs and asides of the hand-labelled documents that are not held out, then those of all that are not held out."""
        ordered = [(f, _by_feature(f)) for f in (self.paragraphs, self.asides)]
        return tuple(Sample(f, documents[f.document], order) for documents in (~(self.held | self.weak), ~self.held) for f, order in ordered)


def train_one(training: Training, label: np.ndarray, *, needed: int = NEEDED, refits: int = 2, turns: int = 3, rounds: int = 20, l2: float = 0.01, aside_l2: float = 0.1, likely: float = 0.4) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """The classifier of one subject: features, weights, bias, and the scores of the held-out documents.

    ``label`` (0 or 1) is by document. The first fits take hand-labelled documents only. Then, for some turns, the documents in
    ``weak`` have the subject if their aside tells it, by a classifier fitted against the hand labels and in later turns also
    against what paragraphs show, or if their own paragraphs show it; the paragraphs of all documents but the held-out ones are
    fitted against these labels. Single paragraphs that may treat the subject in documents without it are left to no side."""
    f, asides, weak, held = training.paragraphs, training.asides, training.weak, training.held
    n = len(label)
    marked = label.astype(bool)
    by_hand = ~(held | weak)

    def kept(part: Features, score: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (y[part.document] & (score >= np.minimum(0.0, _kth(score, part.document, n, needed)[part.document]))).astype(float)

    def shown(score: np.ndarray) -> np.ndarray:
        top = _kth(score, f.document, n, needed)
        return np.where(weak, top >= max(_threshold(top[by_hand], label[by_hand]), -0.5), marked)

    sample, telling, *fitted = training.samples
    target = marked[sample.part.document].astype(float)
    for turn in range(refits + 1):
        used, w, b = _fit(sample, target, rounds, l2)
        if turn < refits:
            target = kept(sample.part, _scores(sample.part, used, w, b), marked)
    score = _scores(f, used, w, b)
    tells = marked[telling.part.document].astype(float)
    for turn in range(turns if weak.any() else 0):
        told, seen = np.zeros(n, dtype=bool), shown(score)
        if turn:
            tells = seen[telling.part.document].astype(float)
        told[asides.document[_scores(asides, *_fit(telling, tells, 30, aside_l2)) >= np.log(likely / (1 - likely))]] = True
        y = np.where(weak, told | seen, marked)
        sample, telling = fitted
        part, own = sample.part, score[sample.rows]
        out = weak[part.document] & ~y[part.document] & (own > 0)
        used, w, b = _fit(sample, kept(part, own, y), rounds, l2, out=out)
        score = _scores(f, used, w, b)
    judged = held[f.document]
    return used, w, b, _kth(score[judged], f.document[judged], n, needed)[held]


def _take(f: Features, rows: np.ndarray) -> Features:
    size = np.diff(f.start)
    return Features(f.index[np.repeat(rows, size)], np.concatenate([[0], np.cumsum(size[rows])]), f.document[rows])


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """Middle of the stretch of thresholds with the best F1 against the labels; 0 without labels to go by."""
    finite = np.isfinite(score)
    s, y = score[finite], label[finite].astype(bool)
    if not y.any():
        return 0.0
    order = np.argsort(-s)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + label.sum())
    at = int(np.argmax(f1))
    lower = s[order[at + 1]] if at + 1 < len(s) else s[order[at]] - 1
    return float((s[order[at]] + lower) / 2)


def thresholds(tops: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Per subject the threshold with the best F1 on the held-out documents (documents x subjects), drawn towards that of all subjects
    together as if ``prior`` labels spoke for it; 0 without any label."""
    pooled = _threshold(tops.ravel(), labels.ravel())
    n = labels.sum(axis=0)
    own = np.array([_threshold(tops[:, j], labels[:, j]) for j in range(labels.shape[1])])
    return (n * own + prior * pooled) / (n + prior)


def _collected(rows: DataFrame, sections: Sections, asides: bool) -> tuple[pa.Table, Features]:
    """(id, labels) and the features of a bounded sample (__id, __text, __labels), which executors extract."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 500):
                f = features(part.column("__text"), sections, asides=asides)
                bounds = np.searchsorted(f.document, np.arange(part.num_rows + 1))
                cut = lambda i: (f.start[bounds[i] : bounds[i + 1] + 1], f.index[f.start[bounds[i]] : f.start[bounds[i + 1]]])  # noqa: E731, B023
                sizes = pa.array([np.diff(cut(i)[0]).astype("<i8").tobytes() for i in range(part.num_rows)], type=pa.binary())
                index = pa.array([cut(i)[1].astype("<i4").tobytes() for i in range(part.num_rows)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__labels"), sizes, index], names=["id", "labels", "sizes", "index"])

    t = rows.select("__id", "__text", "__labels").mapInArrow(run, "id long, labels array<string>, sizes binary, index binary").toArrow().sort_by("id")
    sizes = [np.frombuffer(x, dtype="<i8") for x in t["sizes"].to_pylist()]
    flat = np.concatenate([np.empty(0, dtype="<i8"), *sizes])
    index = np.frombuffer(b"".join(t["index"].to_pylist()), dtype="<i4")
    return t.select(["id", "labels"]), Features(index, np.concatenate([[0], np.cumsum(flat)]).astype("int64"), np.repeat(np.arange(len(sizes)), [len(x) for x in sizes]))


def _marks(labels: list, subjects: list[str]) -> np.ndarray:
    no = {s: j for j, s in enumerate(subjects)}
    out = np.zeros((len(labels), len(subjects)), dtype="int8")
    for i, names in enumerate(labels):
        out[i, [no[x] for x in names]] = 1
    return out


def _within(found: DataFrame, max_chars: int) -> DataFrame:
    """Of a bounded sample, in the order of hashes, as many whole documents as have ``max_chars`` characters together."""
    upto, last = 0, None
    for h, i, n in found.select("__h", "__id", F.length("__text")).orderBy("__h", "__id").collect():  # the sample
        upto += n
        if upto > max_chars:
            break
        last = (h, i)
    return found.where("false") if last is None else found.where((F.col("__h") < last[0]) | ((F.col("__h") == last[0]) & (F.col("__id") <= last[1])))


def _joined(a: Features, b: Features, n: int) -> Features:
    """The features of ``n`` documents and of others after them."""
    return Features(np.concatenate([a.index, b.index]), np.concatenate([a.start, b.start[1:] + a.start[-1]]), np.concatenate([a.document, b.document + n]))


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: list[str], *, id_column: str = "doc_id", text: str = "text", label: str = "subject", sections: Sections = Sections(), max_documents: int = 10_000, max_weak: int = 4_000, max_chars: int = 100_000_000, held_out: float = 0.25, prior: float = 10.0, seed: int = 7, **options: object) -> Model:
    """Fit on bounded samples: at most ``max_documents`` hand-labelled documents and ``max_weak`` others, which get weak labels from
    their asides and paragraphs; of either those with the smallest hashes of their ids, and of these, in that order, as many whole
    ones as have ``max_chars`` characters together. Executors extract the features, and each subject is fitted by a task of its own.

    The share ``held_out`` of the hand-labelled documents, at any size, sets the thresholds and never enters a fit. ``prior`` is how
    many held-out labels of a subject weigh as much as the threshold of all subjects together. Labels not in ``subjects`` are passed
    over; null ids and texts are left out; of repeated ids the largest text counts; without labelled documents the model assigns
    nothing. ``options`` go to :func:`train_one`. All jobs run when the function is called.
    """
    require(documents, id_column, text)
    require(labels, id_column, label)
    spark = documents.sparkSession
    ship(spark)
    known = labels.where(col(label).isin(subjects) & col(id_column).isNotNull()).groupBy(col(id_column).cast("long").alias("__id")).agg(F.collect_set(col(label)).alias("__labels"))
    texts = documents.where((F.length(col(text)) > 0) & col(id_column).isNotNull()).select(col(id_column).cast("long").alias("__id"), col(text).alias("__text"))
    hashed = lambda df, most: df.withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(most)
    others = texts.select("__id").join(known.select("__id"), "__id", "left_anti").distinct().withColumn("__labels", F.array().cast("array<string>"))
    sample = hashed(known.join(texts.select("__id").distinct(), "__id", "left_semi"), max_documents).unionByName(hashed(others, max_weak))
    found = stored(texts.join(F.broadcast(sample), "__id").groupBy("__id", "__h", "__labels").agg(F.max("__text").alias("__text")), "sample")  # at most max_documents + max_weak rows are broadcast
    hand, other = (_within(found.where(c), max_chars) for c in ("size(__labels) > 0", "size(__labels) = 0"))
    named, bags = _collected(hand, sections, False)
    if not len(bags.document):
        return Model(subjects, np.zeros((1 << BITS, len(subjects)), dtype="float32"), np.zeros(len(subjects)), np.full(len(subjects), np.inf), sections=sections)
    unnamed, more = _collected(other, sections, False)
    n = len(named)
    y = np.concatenate([_marks(named["labels"].to_pylist(), subjects), np.zeros((len(unnamed), len(subjects)), dtype="int8")])
    weak = np.arange(len(y)) >= n
    held = ~weak & (np.random.default_rng(seed).random(len(y)) < held_out)
    asides = _joined(_collected(hand, sections, True)[1], _collected(other, sections, True)[1], n)
    sent = spark.sparkContext.broadcast((Training(_joined(bags, more, n), asides, weak, held), y))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column("id").to_pylist():
                training, marks = sent.value
                used, w, b, top = train_one(training, marks[:, j], **options)
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([used.astype("<i4").tobytes()]), pa.array([w.astype("<f4").tobytes()]), pa.array([float(b)]), pa.array([top.astype("<f8").tobytes()])], names=["j", "used", "w", "b", "top"])

    weights, bias = np.zeros((1 << BITS, len(subjects)), dtype="float32"), np.zeros(len(subjects))
    tops = np.zeros((int(held.sum()), len(subjects)))
    for r in spark.range(0, len(subjects), 1, len(subjects)).mapInArrow(fit, "j long, used binary, w binary, b double, top binary").collect():  # one per subject
        weights[np.frombuffer(r.used, dtype="<i4"), r.j] = np.frombuffer(r.w, dtype="<f4")
        bias[r.j], tops[:, r.j] = r.b, np.frombuffer(r.top, dtype="<f8")
    return Model(subjects, weights, bias, thresholds(tops, y[held], prior), options.get("needed", NEEDED), sections)


def assign_subjects(documents: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``subject``: every subject of every document, none for documents without; one row per copy of a document.
    Null ids, null and empty texts give no rows; whole texts are read; extra columns are ignored. No shuffle."""
    require(documents, id_column, text)
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.where(col(id_column).isNotNull() & (F.length(col(text)) > 0)).select(col(id_column).cast("long").alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500):
                m = shared.value
                doc, subject = np.nonzero(m.assign(features(part.column("text"), m.sections), part.num_rows))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(np.array(m.subjects, dtype=object)[subject], type=pa.string())], names=["doc_id", "subject"])

    return rows.mapInArrow(run, "doc_id long, subject string")
