"""Mixing sources to target weights in fixed-length blocks of tokens."""

from __future__ import annotations

import base64
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.llm.text import slices
from tickloom.sources.ship import ship
from tickloom.sources.tables import partitions_for, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's pieces are cut from a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOTS = 1024
_LARGEST = 1_000_000
_TOTALS = 1_000_000  # rows of some 40 bytes
_encoders: dict = {}


def _encoder(ranks: bytes):
    """One encoder a Python worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def tokenised(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, with_tokens: bool = False) -> DataFrame:
    """Columns ``id``, ``source``, ``bucket``, ``n_tokens``, ``before`` and, if wanted, ``tokens`` (little-endian 16-bit ids). One row
    per id: of repeated ids the one with the most tokens counts, then the smallest source. Null ids are left out; null and empty
    texts have no tokens.

    Ids are hashed to buckets, as many as the size of the files needs. One exchange by bucket, even whatever the sources' sizes,
    serves both the choice among repeated ids and ``before``: the tokens of the same source and bucket that stand before."""
    require(documents, id_column, text, source)
    ship(documents.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.where(col(id_column).isNotNull()).select(col(id_column).cast("long").alias("id"), col(source).cast("string").alias("source"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or _encoder(shared.value)
            for part in slices(batch, "text", 1_000):
                coded = [encode.encode_ordinary(t or "") for t in part.column("text").to_pylist()]
                out = [part.column("id"), part.column("source"), pa.array([len(c) for c in coded], type=pa.int64())]
                if with_tokens:
                    out.append(pa.array([np.array(c, dtype="<u2").tobytes() for c in coded], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "source", "n_tokens", "tokens"][: len(out)])

    coded = rows.mapInArrow(run, "id long, source string, n_tokens long" + (", tokens binary" if with_tokens else ""))
    buckets = partitions_for(documents)
    placed = coded.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).repartition(buckets, "bucket")
    copies = Window.partitionBy("bucket", "id").orderBy(F.col("n_tokens").desc(), F.col("source").asc_nulls_last())
    one = placed.withColumn("__i", F.row_number().over(copies)).where("__i = 1").drop("__i")
    upto = F.sum("n_tokens").over(Window.partitionBy("bucket", "source").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("before", upto - F.col("n_tokens"))


def running_offsets(df: DataFrame, group: str, order: str, amount: str, width: int = 4_096) -> DataFrame:
    """``start``: sum of ``amount`` over the rows before, per group, in the order of a whole number. Rows are summed in order within
    ``width`` numbers, and the totals of these added, so a group that holds most rows is summed in many tasks."""
    b = df.withColumn("__b", F.floor(F.col(order) / width))
    inner = F.sum(amount).over(Window.partitionBy(group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    return _with_totals(b.withColumn("__in", inner), group, "__b", amount, "__in").drop("__b", "__in")


def _with_totals(df: DataFrame, group: str, bucket: str, amount: str, inner: str, checked: bool = False) -> DataFrame:
    """``start`` from the sums within (group, bucket) and the totals of the group's buckets before: one narrow row each. If
    ``checked`` these are counted, and broadcast if they are few, so that the rows with their payload stay where they are."""
    totals = df.groupBy(group, bucket).agg(F.sum(amount).alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")
    totals = totals.select(F.col(group).alias("__g"), F.col(bucket).alias("__c"), before.alias("__before"))
    if checked:  # one narrow row per group and bucket; beyond the bound Spark joins as it sees fit
        totals = stored(totals, "totals")
        totals = F.broadcast(totals) if totals.count() <= _TOTALS else totals
    joined = df.join(totals, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__c")))
    return joined.withColumn("start", F.col(inner) + F.col("__before")).drop("__g", "__c", "__before")


def _pieces(tokens: DataFrame, block: int) -> DataFrame:
    """``source``, ``block`` and the range ``lo`` to ``hi`` of the source's tokens that each document gives to each of its blocks."""
    laid = _with_totals(tokens.where("n_tokens > 0 and source is not null"), "source", "bucket", "n_tokens", "before", checked=True)
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + n_tokens - 1) div {block}")
    pieces = laid.withColumn("block", F.explode(F.sequence(first, last)))
    return pieces.withColumns({"lo": F.greatest(F.col("block") * block, F.col("start")), "hi": F.least((F.col("block") + 1) * block, F.col("start") + F.col("n_tokens"))})


def block_sizes(tokens: DataFrame, block: int) -> DataFrame:
    """``source``, ``block``, ``n_tokens`` of the packed blocks; only numbers are read and exchanged."""
    return _pieces(tokens.drop("tokens"), block).groupBy("source", "block").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_tokens"))


def pack(tokens: DataFrame, block: int) -> DataFrame:
    """Fixed-length blocks per source: ``source``, ``block`` (from 0), ``tokens``. Documents follow each other by bucket and id and
    run on over block ends; only a source's last block may be short. One exchange of tokens."""
    p = _pieces(tokens, block)
    cut = F.substring("tokens", ((F.col("lo") - F.col("start")) * 2 + 1).cast("int"), ((F.col("hi") - F.col("lo")) * 2).cast("int"))
    parts = p.select("source", "block", F.struct((F.col("lo") - F.col("block") * block).alias("at"), cut.alias("t")).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["t"]))
    return parts.groupBy("source", "block").agg(joined.alias("tokens"))


def source_sizes(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))


def plan(sizes: list[tuple], targets: list[tuple], block: int, total: int | None = None, full: Collection[str] = ()) -> list[dict]:
    """What each target source gives: sizes are (source, documents, tokens), targets (source, share, max_uses).

    ``needed_tokens`` is its share of the total (all documents once unless given), ``capacity_tokens`` its size times max_uses.
    ``weight`` is the share to draw. A source whose capacity does not reach what it needs gives all its blocks max_uses times, as a
    ``quota`` (else null); so does one of ``full`` and one to which what others leave open would give more than it has. What they
    leave open goes to the other sources in proportion.
    """
    have = {s: (d, t) for s, d, t in sizes if s is not None}
    total = sum(t for _, _, t in sizes) if total is None else total
    rows = []
    for s, share, uses in targets:
        documents, tokens = have.get(s, (0, 0))
        uses = max(0, uses or 0)
        rows.append({"source": s, "target_share": share or 0.0, "max_uses": uses, "documents": documents, "tokens": tokens, "needed_tokens": (share or 0.0) * total, "capacity_tokens": tokens * uses, "blocks": -(-tokens // block)})
    most = {r["source"]: r["blocks"] * r["max_uses"] for r in rows}
    fixed = {r["source"] for r in rows if r["needed_tokens"] > r["capacity_tokens"]} | set(full)
    slots = max(-(-total // block), sum(most[s] for s in fixed))
    while True:  # every round fixes a source
        open_share = sum(r["target_share"] for r in rows if r["source"] not in fixed)
        rest = max(0, slots - sum(most[s] for s in fixed))
        wanted = {r["source"]: rest * r["target_share"] / open_share if open_share else 0.0 for r in rows if r["source"] not in fixed}
        over = {s for s, x in wanted.items() if x > most[s]}
        if not over:
            for r in rows:
                s = r["source"]
                r |= {"quota": most[s] if s in fixed else None, "weight": (most[s] if s in fixed else wanted[s]) / slots if slots else 0.0, "slots": slots}
            return rows
        fixed |= over


def drawn_counts(spark: SparkSession, planned: list[dict], seed: int = 0, per_shard: int = SLOTS) -> DataFrame:
    """``shard``, ``source_no``, ``n``: how many slots of each output shard each source gets. Quotas are spread over all slots by a
    pseudorandom permutation; the other slots of a shard are drawn from the multinomial distribution of the open weights.

    Everything follows from seed and shard number, so a task that is run again draws the same."""
    ship(spark)
    slots = planned[0]["slots"]
    ends = np.cumsum([r["quota"] or 0 for r in planned], dtype="int64")
    whole = int(ends[-1])
    p = np.array([0.0 if r["quota"] is not None else r["weight"] for r in planned])
    filled = bool(p.sum() > 0)
    p = p / p.sum() if filled else p

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"].tolist():
                lo, hi = shard * per_shard, min(slots, (shard + 1) * per_shard)
                a, b = whole * lo // slots, whole * hi // slots
                full = lambda x, n=b - a: np.full(n, x)
                own = np.searchsorted(ends, permuted(np.arange(a, b), full(whole), full(len(ends)), full(0), seed), side="right") if b > a else np.empty(0, dtype=int)
                n = np.bincount(own, minlength=len(ends))
                if filled:
                    n = n + np.random.default_rng([seed, shard]).multinomial(hi - lo - (b - a), p)
                yield pd.DataFrame({"shard": shard, "source_no": np.arange(len(n)), "n": n})

    return spark.range(-(-slots // per_shard)).mapInPandas(counts, "shard long, source_no long, n long").where("n > 0")


def within_capacity(spark: SparkSession, sizes: list[tuple], targets: list[tuple], block: int, total: int | None, seed: int, per_shard: int = SLOTS) -> list[dict]:
    """The plan whose drawn counts exceed no source's capacity: a source that chance gave more than its blocks have uses is set to
    all it has, and the rest drawn again. Each round sets a source, most often the first is the last."""
    full: set[str] = set()
    while True:
        planned = plan(sizes, targets, block, total, full)
        if not planned or not planned[0]["slots"] or all(r["quota"] is not None for r in planned):
            return planned
        got = {r.source_no: r.n for r in drawn_counts(spark, planned, seed, per_shard).groupBy("source_no").agg(F.sum("n").alias("n")).collect()}  # one per target
        over = {r["source"] for i, r in enumerate(planned) if got.get(i, 0) > r["blocks"] * r["max_uses"]}
        if not over:
            return planned
        full |= over


def draw_slots(spark: SparkSession, planned: list[dict], seed: int = 0, per_shard: int = SLOTS) -> DataFrame:
    """``shard``, ``position``, ``source``, ``block``, ``use`` (from 0): the drawn slots, numbered per source over the shards and mapped
    to blocks by a pseudorandom permutation of the source's blocks for each use."""
    if not planned or not planned[0]["slots"]:
        return spark.createDataFrame([], "shard long, position long, source string, block long, use long")
    names = [r["source"] for r in planned]
    blocks = np.array([max(1, r["blocks"]) for r in planned], dtype="int64")
    numbered = running_offsets(drawn_counts(spark, planned, seed, per_shard), "source_no", "shard", "n")
    opened = numbered.select("shard", "source_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            no, slot = f["source_no"].to_numpy(), f["slot"].to_numpy()
            n = blocks[no]
            use = slot // n
            f = f.assign(use=use, block=permuted(slot % n, n, no, use, seed), source=np.array(names, dtype=object)[no])
            yield f[["shard", "source", "slot", "block", "use"]]

    placed = opened.mapInPandas(place, "shard long, source string, slot long, block long, use long")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("source", "slot", F.lit(seed)))
    return placed.select("shard", (F.row_number().over(shuffled) - 1).cast("long").alias("position"), "source", "block", "use")


def permuted(index: np.ndarray, n: np.ndarray, source: np.ndarray, use: np.ndarray, seed: int) -> np.ndarray:
    """Image of each index under its (source, use)'s permutation of 0..n-1: a four-round Feistel network on the smallest even
    number of bits, walked until it falls below n."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2))).astype("int64"))
    half = ((bits + 1) // 2).astype("uint64")
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        key = (source.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) ^ (use.astype("uint64") * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x165667B19E3779F9))
        out = index.astype("uint64")
        todo = np.arange(len(out))
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                f = (right + k + np.uint64(r + 1)) * np.uint64(0xFF51AFD7ED558CCD)
                f ^= f >> np.uint64(33)
                f *= np.uint64(0xC4CEB9FE1A85EC53)
                f ^= f >> np.uint64(29)
                left, right = right, left ^ (f & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo].astype("uint64")]
    return out.astype("int64")


def _planned(tokens: DataFrame, targets: DataFrame, block: int, total: int | None, seed: int) -> list[dict]:
    require(targets, "source", "target_share", "max_uses")
    goals = targets.where("source is not null").groupBy(F.col("source").cast("string").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_uses").alias("uses")).orderBy("source")
    if goals.count() > _LARGEST:
        raise ValueError(f"more than {_LARGEST} target sources")
    known = goals.select(F.col("source").alias("__known"))
    # All other sources as one row, so no more rows are collected than there are targets.
    sizes = source_sizes(tokens).join(known, F.col("source") == F.col("__known"), "left").groupBy("__known").agg(F.sum("documents"), F.sum("tokens"))
    return within_capacity(tokens.sparkSession, [(r[0], r[1], r[2] or 0) for r in sizes.collect()], [tuple(g) for g in goals.collect()], block, total, seed)


_REPORT = "source string, target_share double, max_uses long, documents long, tokens long, needed_tokens double, capacity_tokens long, blocks long"


def _report(spark: SparkSession, tokens: DataFrame, planned: list[dict], block: int, seed: int) -> DataFrame:
    used = draw_slots(spark, planned, seed).groupBy("source", "block").agg(F.count(F.lit(1)).alias("u"))
    # The slots grow from a range of shard numbers, which Catalyst takes for tiny: without the hint it would broadcast them.
    sized = used.hint("merge").join(block_sizes(tokens, block), ["source", "block"])
    per = sized.groupBy("source").agg(F.sum("u").alias("drawn_blocks"), F.sum(F.col("u") * F.col("n_tokens")).alias("drawn_tokens"), F.max("u").alias("most_uses"))
    names = [x.split()[0] for x in _REPORT.split(", ")]
    base = spark.createDataFrame([tuple(r[k] for k in names) for r in planned], _REPORT)  # one row per target
    out = base.join(per, "source", "left").fillna(0, ["drawn_blocks", "drawn_tokens", "most_uses"])
    # A source cannot reach its share if it gives less though all its blocks are used as often as they may be.
    short = (F.col("drawn_tokens") < F.col("needed_tokens")) & (F.col("drawn_blocks") >= F.col("blocks") * F.col("max_uses"))
    whole = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target
    return out.withColumn("reached_share", F.try_divide(F.col("drawn_tokens"), whole)).select(*names, short.alias("short"), "drawn_blocks", "drawn_tokens", "reached_share", "most_uses")


def _blocks(spark: SparkSession, tokens: DataFrame, planned: list[dict], block: int, seed: int) -> DataFrame:
    slots = draw_slots(spark, planned, seed)
    return slots.hint("merge").join(pack(tokens, block), ["source", "block"]).select("shard", "position", "source", "block", "use", "tokens")


_NAMES = {"id_column": "doc_id", "text": "text", "source": "source"}


def mix_report(documents: DataFrame, targets: DataFrame, *, block: int = 1024, total: int | None = None, seed: int = 0, **columns: str) -> DataFrame:
    """Per target source: share asked for and reached, sizes in tokens, whether it falls ``short`` of its share at max_uses, blocks
    and tokens drawn, and how often its most used block is used, all from the drawn slots and the blocks that they stand for.

    ``targets``: source, target_share, max_uses. Documents of null or other sources count in the size of all documents but are not
    drawn. A target source without documents is short. Empty documents give zero sizes. The driver gets one row per target.
    Counting the tokens, which are written as one number per document, and the draw's totals run when the function is called.
    """
    tokens = stored(tokenised(documents, **_NAMES | columns), "counts")
    return _report(documents.sparkSession, tokens, _planned(tokens, targets, block, total, seed), block, seed)


def mix(documents: DataFrame, targets: DataFrame, *, block: int = 1024, total: int | None = None, seed: int = 0, **columns: str) -> DataFrame:
    """The mixture itself: ``shard``, ``position``, ``source``, ``block``, ``use``, ``tokens``. Packed blocks are joined by (source,
    block), which spreads evenly; no block is used more than max_uses times, hence no document. The documents are tokenised, once,
    into a table in the shared folder when the function is called."""
    return mix_with_report(documents, targets, block=block, total=total, seed=seed, **columns)[0]


def mix_with_report(documents: DataFrame, targets: DataFrame, *, block: int = 1024, total: int | None = None, seed: int = 0, **columns: str) -> tuple[DataFrame, DataFrame]:
    """:func:`mix` and :func:`mix_report` from one tokenisation."""
    spark = documents.sparkSession
    tokens = stored(tokenised(documents, with_tokens=True, **_NAMES | columns), "tokens")  # sizes, offsets and slices all read it
    planned = _planned(tokens, targets, block, total, seed)
    return _blocks(spark, tokens, planned, block, seed), _report(spark, tokens, planned, block, seed)
