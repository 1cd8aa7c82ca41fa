"""Mixing sources to target weights, with DataFrame functions alone.

1. Words are counted; sources get their targets by water-filling under the cap of PASSES times their size.
2. Every source's words, in an order of hash bucket and doc_id, are packed into blocks of BLOCK words. Offsets are
   prefix sums in two levels (buckets within a source, rows within a bucket), so no task holds a whole source.
3. Every source has as many block slots as its target asks for (the last may take part of a block). Slots fall on
   output shards by a seeded hash: each shard's counts by source are multinomial, given the sources' totals.
4. Numbered through the shards, a source's slots pass through its pseudorandom permutation of block indices (rounds
   of swap-or-not, a bijection for any number of blocks), a new one each time all blocks are used up.
5. Slots and blocks are joined by (source, index). A block is taken at most as often as passes were begun.

Everything is a function of the rows and the seed: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last; sources without words have
target 0; rows of a doc_id count one by one; with no words at all every target is 0. ``taken`` is at most PASSES
times the size, since a source's target is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import common as C

BLOCK = 128
SHARD_SLOTS = 4096
RUN = 8192
TASK_SLOTS = 200_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
ROUNDS = 12
SEED = 20240607
BROADCAST_SOURCES = 10_000  # beyond so many sources their table is joined by shuffles


def _permuted(i: Column, n: Column, key: Column) -> Column:
    """Swap-or-not rounds over 0..n-1; key chooses the permutation."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, F.greatest(x, other), -1 - r) % 2 == 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(SEED), F.lit(SEED + ROUNDS - 1)), i, turn)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: sid (its rank by code point from 1, null last), source, source_size, target."""
    # One row per source only: the windows below order the list of sources, not rows of the corpus.
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").isNull(), C.code_point_key(F.col("source")))
    s = s.withColumn("sid", F.row_number().over(rank))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(PASSES)) * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    weight_left = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    s = s.withColumn("target", F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("w")))
    return s.select("sid", "source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per row of docs(doc_id, text, source): doc_id, th (a hash of the text), source, size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(text, F.lit(C.WORD_PATTERN), F.lit(0))).cast("long").alias("size"))


def _slots(sources: DataFrame) -> DataFrame:
    """One row per drawn slot: sid, shard, index of its block, n words of it to take."""
    s = sources.filter("source_size > 0").select("sid", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("aim"))
    s = s.withColumns({"full": F.expr(f"source_size div {BLOCK}"), "tail": F.col("source_size") % BLOCK, "passes": F.expr("aim div source_size"), "rest": F.col("aim") % F.col("source_size")})
    s = s.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
    s = s.withColumns({"k": F.expr(f"rest div {BLOCK}"), "x": F.col("rest") % BLOCK})
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("k") + (F.col("x") > 0).cast("long")).filter("slots > 0")
    s = C.cut(s)
    total = s.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_SLOTS))
    # Runs of slots, and later the shards' counts, are numbers first, spread over a number of tasks that grows with the slots (a
    # stated number, which adaptive execution leaves alone), and only there become rows.
    tasks = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_SLOTS))
    runs = s.select("sid", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {RUN}"))).alias("run")).repartition(tasks, "sid", "run")
    each = runs.select("sid", F.explode(F.sequence(F.expr(f"run * {RUN}"), F.least(F.expr(f"run * {RUN} + {RUN - 1}"), F.col("slots") - 1))).alias("j"))
    counts = each.select("sid", F.pmod(F.xxhash64("sid", "j", F.lit(SEED)), F.lit(shards)).alias("shard")).groupBy("shard", "sid").agg(F.count("*").alias("n"))
    order = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long"))).repartition(tasks, "sid", "shard")
    drawn = counts.select("shard", "sid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("j")).join(_small(s.drop("source_size", "aim", "rest", "slots")), "sid")
    drawn = drawn.withColumns({"turn": F.expr("j div blocks"), "i": F.expr("j % blocks")})
    index = F.when(F.col("i") < F.col("full"), _permuted(F.col("i"), F.greatest(F.col("full"), F.lit(1)), F.struct("sid", "turn"))).otherwise(F.col("full"))
    partial = (F.col("turn") == F.col("passes")) & (F.col("i") == F.col("k"))
    n = F.when(partial, F.col("x")).when(F.col("i") < F.col("full"), F.lit(BLOCK).cast("long")).otherwise(F.col("tail"))
    return drawn.select("sid", "shard", index.alias("index"), n.alias("n"))


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint for a checkpointed table of sources while they are few."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def draw(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs with their source's numbers, and what the mix takes of each.

    Rows: doc_id, th, copy (numbers equal rows), size, source_size, target. Takes: doc_id, th, copy, pass, shard, lo, hi
    (words of the document from lo to before hi).
    """
    narrow = C.written(sized(docs), "sized")
    sources = C.cut(targets(narrow))
    copies = Window.partitionBy("doc_id", "th").orderBy("source")
    rows = narrow.withColumn("copy", F.row_number().over(copies))
    known = _small(sources)
    rows = rows.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    groups = C.parts(C.text_bytes(docs), 8 << 20)
    rows = C.cut(rows.select("doc_id", "th", "copy", "sid", "size", "source_size", "target", F.pmod(F.xxhash64("doc_id", "th"), F.lit(groups)).alias("group")))
    before = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("sid", "group").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long"))).drop("words")
    inner = Window.partitionBy("sid", "group").orderBy("doc_id", "th", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.filter("size > 0").withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0).cast("long"))).join(base, ["sid", "group"])
    placed = placed.select("doc_id", "th", "copy", "sid", "size", (F.col("base") + F.col("inner")).alias("from"))
    pieces = placed.select("*", F.explode(F.sequence(F.expr(f"`from` div {BLOCK}"), F.expr(f"(`from` + size - 1) div {BLOCK}"))).alias("index"))
    taken = _slots(sources).withColumn("pass", F.row_number().over(Window.partitionBy("sid", "index").orderBy(F.desc("n"), "shard")))
    met = pieces.join(taken, ["sid", "index"])
    lo = F.greatest(F.col("index") * BLOCK, F.col("from")) - F.col("from")
    hi = F.least(F.col("index") * BLOCK + F.col("n"), F.col("from") + F.col("size")) - F.col("from")
    met = met.select("doc_id", "th", "copy", "pass", "shard", lo.alias("lo"), hi.alias("hi")).filter("hi > lo")
    return rows, met


def mix(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs' own columns: one for each document and pass, with the words that this pass takes.

    Where a pass takes a whole document its text is unchanged; else it is the words taken, in order, joined by one space.
    """
    _, takes = draw(docs)
    takes = takes.groupBy("doc_id", "th", "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum(F.col("hi") - F.col("lo")).alias("n"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col("source").cast("string").alias("source"))
    keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("source"))).drop("source")
    t = takes.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("copy").alias("c"), "ranges", "n")
    both = keyed.join(t, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("copy") == F.col("c")))
    whole = F.col(f"row.c{docs.columns.index('text')}").cast("string")
    w = F.regexp_extract_all(whole, F.lit(C.WORD_PATTERN), F.lit(0))
    part = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice("w", (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    both = both.withColumn("w", w).withColumn("new", F.when(F.col("n") == F.size("w"), whole).otherwise(part))
    out = {f.name: F.col(f"row.c{i}") for i, f in enumerate(docs.schema.fields)}
    out["text"] = F.col("new")
    if "n_chars" in out:
        out["n_chars"] = F.length("new")
    return both.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, takes = draw(C.documents(spark, sf_dir, "doc_id", "text", "source"))
    sums = takes.groupBy("doc_id", "th", "copy").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    sums = sums.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("copy").alias("c"), "taken")
    both = rows.join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("copy") == F.col("c")), "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
