"""Queries p4 over quotes and ticks, p6 to p8 over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import tidy_symbol
from tickloom.llm import text
from tickloom.llm.leaks import find_leaks
from tickloom.llm.mixing import mix, mix_report, mix_with_report
from tickloom.llm.nearest import nearest_match
from tickloom.llm.subjects import Sections, assign_subjects, fit_subjects
from tickloom.sources.tables import read_table


def _pairs(spark: SparkSession, directory: str, **options: object) -> DataFrame:
    tidy = lambda df: df.withColumn("symbol", tidy_symbol("symbol"))
    quotes = tidy(read_table(spark, directory, "quotes").select("quote_id", "ts_event", "symbol"))
    ticks = tidy(read_table(spark, directory, "ticks").select("tick_id", "timestamp", "symbol"))
    return nearest_match(quotes, ticks, left_key="symbol", left_time="ts_event", left_id="quote_id", right_key="symbol", right_time="timestamp", right_id="tick_id", tolerance="2s", **options)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).select(F.col("left_id").alias("quote_id"), F.col("right_id").alias("tick_id")).distinct()


def p4_offsets(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).select(F.col("left_id").alias("quote_id"), F.col("right_id").alias("tick_id"), "offset_us").distinct()


def p4_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    """The quotes without a tick within the tolerance, those without symbol or time included."""
    return _pairs(spark, directory, keep_unmatched=True).where("right_id is null").select(F.col("left_id").alias("quote_id")).distinct()


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_leaks(read_table(spark, directory, "documents"), read_table(spark, directory, "eval_items")).select("doc_id", "item_id").distinct()


def p6_quoted(spark: SparkSession, directory: str) -> DataFrame:
    """The leaks without any altered word."""
    return find_leaks(read_table(spark, directory, "documents"), read_table(spark, directory, "eval_items"), altered=0.0).select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return p7_report(spark, directory).where("short").select("source")


def p7_report(spark: SparkSession, directory: str) -> DataFrame:
    return mix_report(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_targets"))


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mix(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_targets"))
    return mixed.select("shard", "position", "source", "block", "use", (F.octet_length("tokens") / 2).cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("digest"))


def p7_rules(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of any mixture, per source: no block is used more often than allowed nor twice as the same use, a source that
    is not exhausted gets its share within chance, report and mixture agree, a short source gives all it has."""
    targets = read_table(spark, directory, "mix_targets")
    blocks, report = mix_with_report(read_table(spark, directory, "documents"), targets)
    per = blocks.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("use").alias("uses"), F.max("use").alias("last"), F.sum(F.octet_length("tokens") / 2).cast("long").alias("t"))
    seen = per.groupBy("source").agg(F.max("n").alias("most"), F.max(F.col("n") - F.col("uses")).alias("again"), F.max("last").alias("last"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    slots = F.sum("drawn_blocks").over(Window.partitionBy())  # one row per target
    left = F.sum(F.when(F.col("drawn_blocks") >= F.col("blocks") * F.col("max_uses"), F.col("drawn_blocks")).otherwise(0)).over(Window.partitionBy())
    open_share = F.sum(F.when(F.col("drawn_blocks") < F.col("blocks") * F.col("max_uses"), F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())
    x = report.withColumns({"expected": (slots - left) * F.col("target_share") / open_share}).join(seen, "source", "left")
    exhausted = F.col("drawn_blocks") >= F.col("blocks") * F.col("max_uses")
    return x.select(
        "source",
        (F.coalesce("most", F.lit(0)) <= F.col("max_uses")).alias("uses_kept"), (F.coalesce("again", F.lit(0)) == 0).alias("uses_differ"), (F.coalesce("last", F.lit(-1)) < F.col("max_uses")).alias("uses_numbered"),
        ((F.coalesce("t", F.lit(0)) == F.col("drawn_tokens")) & (F.coalesce("n", F.lit(0)) == F.col("drawn_blocks"))).alias("report_agrees"),
        (exhausted | (F.abs(F.col("drawn_blocks") - F.col("expected")) <= 6 * F.sqrt(F.col("expected")) + 1)).alias("share_kept"),
        (F.col("short") == (F.col("needed_tokens") > F.col("capacity_tokens"))).alias("short_is_right"), (~F.col("short") | (F.col("drawn_tokens") == F.col("capacity_tokens"))).alias("short_gives_all"),
    )


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents")
    subjects = [r[0] for r in read_table(spark, directory, "subjects").select("subject").where("subject is not null").distinct().orderBy("subject").collect()]  # a fixed list
    numbered = Sections(between=None)  # only numbered paragraphs make a subject
    model = fit_subjects(documents, read_table(spark, directory, "doc_labels"), subjects, sections=numbered)
    return assign_subjects(documents, model).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_offsets, p4_unmatched, p6_found, p6_quoted, p7_found, p7_report, p7_mix, p7_rules, p8_found)}


def _plain_sql(column: str) -> str:
    """The squeezed text, but for entities that stand for letters."""
    steps = [(r"\r\n?", "\n"), (text.PAGE, ""), (text.NUMBER, "\n"), (text.TAG, " "), (text.MARKS, " ")]
    out = column
    for pattern, by in steps:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return f"regexp_replace(regexp_replace(lower({out}), {_quoted(text.BLANK)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SYM = "upper(trim(symbol))"
_P4 = f"""with t as (select {_SYM} as s, timestamp as ts, min(tick_id) as tick_id from ticks where symbol is not null and timestamp is not null group by 1, 2),
q as (select distinct quote_id, {_SYM} as s, ts_event as ts from quotes where symbol is not null and ts_event is not null),
b as (select q.*, t.ts as bt, t.tick_id as bid from q asof left join t on q.s = t.s and q.ts >= t.ts),
a as (select b.*, t.ts as nt, t.tick_id as aid from b asof left join t on b.s = t.s and b.ts <= t.ts),
d as (select *, date_diff('microsecond', bt, ts) as db, date_diff('microsecond', ts, nt) as da from a),
m as (select quote_id, case when db is not null and (da is null or db <= da) then bid else aid end as tick_id, case when db is not null and (da is null or db <= da) then -db else da end as offset_us from d)
select {{}} from m where abs(offset_us) <= 2000000"""

_QUOTED = f"""with d as (select doc_id, {_plain_sql("text")} as body from documents where doc_id is not null and length(text) > 0),
i as (select item_id, list_filter(list_transform(string_split_regex(lower(passage), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: w <> '') as words from eval_items where item_id is not null and passage is not null),
q as (select distinct item_id, array_to_string(words[k : k + 19], '') as quote from (select item_id, words, unnest(range(1, len(words) - 18)) as k from i))
select distinct doc_id, item_id from d join q on contains(body, quote)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4.format("quote_id, tick_id"),
        "p4_offsets": _P4.format("quote_id, tick_id, offset_us"),
        "p4_unmatched": f"select distinct quote_id from quotes where quote_id not in (select quote_id from ({_P4.format('quote_id')}))",
        "p6_quoted": _QUOTED,
        "p7_rules": "select source, true as uses_kept, true as uses_differ, true as uses_numbered, true as report_agrees, true as share_kept, true as short_is_right, true as short_gives_all from mix_targets",
    }
