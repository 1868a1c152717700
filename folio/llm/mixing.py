"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks of words, and a seeded choice of blocks."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import SPACE, longs, table, written
from folio.llm.sketch import BLANK

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 16
SEED = 42
LISTED = 100_000  # quotients that the driver puts in order
SENT_SOURCES = 10_000  # rows of sources that a join may broadcast


def word_count(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with `index`, in code-point order, null last; the driver sees a count for each part of the sorted table."""
    parted = written(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    before, bases = 0, []
    for r in parted.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        bases += [0] * (r["part"] - len(bases)) + [before]
        before += r["n"]
    index = F.get(longs(bases or [0]), F.shiftright("at", 33)) + F.col("at").bitwiseAND((1 << 33) - 1)
    return parted.withColumn("index", index).drop("at")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> tuple[DataFrame, float]:
    """(sources with `target`, all targets together). sources: index, source_size.

    Targets share `share` times all words by weight (weights in turn by index), none above `most`
    times its size, the excess reshared by weight: a source takes its weight times one rate, or
    its limit. The rate only rises while further sources reach their limits, and each step is an
    aggregation; the driver sees four numbers a step.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("index") % len(weights)).cast("int"))
    rows = written(sources.withColumns({"weight": weight, "most": F.col("source_size") * float(most)}))
    all_ = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("most"), F.lit(0.0)).alias("most"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total, rate, known = min(share * all_["n"], all_["most"]), None, -1
    while all_["weight"]:
        full = F.lit(False) if rate is None else F.col("most") < F.lit(rate) * F.col("weight")
        row = rows.agg(F.count_if(full).alias("k"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if row["k"] == known or not row["w"]:
            rate = rate if row["w"] else float("inf")
            break
        known, rate = row["k"], (total - row["taken"]) / row["w"]
    target = F.least(F.col("most"), F.lit(0.0 if rate is None else rate) * F.col("weight")) if rate != float("inf") else F.col("most")
    return rows.withColumn("target", target.cast("double")), total


def apportioned(parties: DataFrame, seats: int, listed: int = LISTED) -> DataFrame:
    """parties (index, shard, votes, most) with `seats`: by highest quotients votes / (2 k + 1), ties to the smaller index and shard, never above `most`.

    With a divisor, each party has a number of seats of its own, so the quotient that comes last
    is between two divisors that sums over all parties close in on, 32 at a time. Only the quotients
    between the last two come to the driver: `listed` of them, or more where so many are equal.
    """
    rows = parties.where("votes > 0 and most > 0")
    able = rows.agg(F.coalesce(F.sum("votes"), F.lit(0.0)).alias("v"), F.coalesce(F.sum("most"), F.lit(0)).alias("m")).first()
    seats = min(seats, able["m"])

    def at(x: float) -> Column:
        return F.least(F.col("most"), F.floor(F.col("votes") * F.lit(x) + 0.5))

    low, high, found = 0.0, 0.0, {0.0: 0}
    if seats:
        middle = seats / able["v"]
        low, high = middle * 0.999, middle * 1.001
        while True:
            grid = [low + (high - low) * i / 31 for i in range(32)]
            row = rows.agg(*[F.sum(at(x)).alias(f"s{i}") for i, x in enumerate(grid)]).first()
            found |= {x: row[f"s{i}"] for i, x in enumerate(grid)}
            if found[grid[0]] > seats:
                low, high = 0.0, low
                continue
            if found[grid[-1]] < seats:
                low, high = high, high * 2
                continue
            low = max(x for x in grid if found[x] <= seats)
            high = min(x for x in grid if found[x] >= seats and x >= low)
            if found[high] - found[low] <= listed or high - low <= 1e-11 * high:
                break
    # quotients within rounding of the two divisors are listed too
    low, high = low * (1 - 1e-12), high * (1 + 1e-12)
    own = parties.withColumn("__low", F.when((F.col("votes") > 0) & (F.col("most") > 0), at(low)).otherwise(0).cast("long"))
    between = own.where((F.col("votes") > 0) & (F.col("most") > 0)).withColumn("__high", at(high)).where("__high > __low")
    some = between.select("index", "shard", "votes", "__low", "__high").collect()
    need = seats - (own.agg(F.coalesce(F.sum("__low"), F.lit(0)).alias("n")).first()["n"])
    ordered = sorted((-r["votes"] / (2 * k + 1), r["index"], r["shard"]) for r in some for k in range(r["__low"], r["__high"]))
    won: dict[tuple[int, int], int] = {}
    for _, i, j in ordered[:need]:
        won[i, j] = won.get((i, j), 0) + 1
    more = parties.sparkSession.createDataFrame([(i, j, n) for (i, j), n in won.items()], "index long, shard long, __won long")
    more = F.broadcast(more) if len(won) <= LISTED else more
    return own.join(more, ["index", "shard"], "left").withColumn("seats", F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__low", "__won")


def seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, whole (times all of it is taken), first (words taken once more), taken; and `keep`.

    Sources in code-point order, null last, weigh `weights` in turn. A source's documents are
    dealt to shards of about `shard_words` words, however large the table, by a seeded hash and put end to end there in its order; blocks are stretches
    of `block_words` words of a shard. Each shard gets a whole number of blocks: every block as
    often as it goes, and the rest from the start of the seeded order. So a document is taken at
    most twice, and one document a shard is cut.

    Sources and shards are tables; the driver sees sums of them and the quotients that are nearest to
    the last seat. Empty and null texts have size 0 and are taken whole with 0 words; a very long
    text is a shard's like any other. Rows with equal doc_id are ordered by size. Empty sources have
    target 0; an empty table gives an empty result.
    """
    keep = keep or []

    def sized(*more: str) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("__source"), word_count(F.col("text").cast("string")).alias("size"), *more)

    own = written(sized())
    sources, total = with_targets(numbered(own.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))), weights, share)
    sources = written(sources.select("source", "index", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards")))
    few = sources.count() <= SENT_SOURCES
    key = seeded(F.col("doc_id"), seed)

    def deal(rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(sources) if few else sources, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
        return out.withColumns({"__key": key, "shard": F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % F.col("shards")})

    dealt = deal(own)
    held = dealt.groupBy("index", "shard").agg(F.sum("size").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s"))
    blocks = F.ceil(F.col("n") / block_words).cast("long")
    votes = F.when(F.col("s") > 0, F.col("t") * F.col("n") / F.col("s")).otherwise(0.0)
    parties = written(held.select("index", "shard", blocks.alias("blocks"), votes.alias("votes"), (REPEATS * blocks).alias("most")))
    quotas = apportioned(parties, floor(total / block_words + 0.5))
    some = F.col("blocks") > 0
    plan = written(quotas.select("index", "shard", F.when(some, F.expr("seats div blocks")).otherwise(0).alias("whole"), F.when(some, F.col("seats") % F.col("blocks") * block_words).otherwise(0).alias("words")))

    order = Window.partitionBy("index", "shard").orderBy("__key", "doc_id", "size")
    # what is kept of a row is carried from here on only, through one shuffle
    spread = (deal(sized(*keep)) if keep else dealt).withColumn("__end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - (F.col("__end") - F.col("size"))))
    out = spread.join(plan, ["index", "shard"]).withColumn("first", first)
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("first")).select("doc_id", "size", "source_size", "target", "whole", "first", "taken", *keep)


def first_words(text: Column, count: Column) -> Column:
    """text up to the end of its count-th word, white space before it as it is."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.rtrim(F.array_join(F.slice(parts, F.lit(1), (count + blank).cast("int")), ""), F.lit(BLANK))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, whole as often as they are taken, and cut to the first words where blocks end.

    Documents of which no word is taken go, and so do null, empty and blank ones; n_chars, if
    there, follows the text. Other columns stay, whatever their names. An empty table gives an empty
    result.
    """
    rows = mix(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), keep=["__row"], **options).where("taken > 0")
    text = F.col("__row.text")
    copies = F.concat(F.array_repeat(text, F.col("whole").cast("int")), F.when(F.col("first") > 0, F.array(first_words(text, F.col("first")))).otherwise(F.array().cast("array<string>")))
    out = rows.select("__row", F.explode(copies).alias("__text"))
    changed = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return out.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL: targets by the prefix of sources in the order of cap over weight, quotas by ranking all quotients.
SQL = f"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM doc GROUP BY source),
cap AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM src),
level AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM cap),
tgt AS (SELECT source, idx, source_size, least(most, w * coalesce((SELECT arg_min(rate, {{'r': most / w, 'i': idx}}) FROM level WHERE rate * w <= most), 1e300)) AS target FROM level),
sharded AS (
  SELECT d.*, t.idx, t.source_size, t.target,
         CAST('0x' || substr(d.k, 1, 15) AS BIGINT) % greatest(1, CAST(ceil(t.source_size / {SHARD_WORDS}) AS BIGINT)) AS shard
  FROM doc d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
held AS (
  SELECT idx, shard, CAST(ceil(sum(size) / {BLOCK_WORDS}.0) AS BIGINT) AS blocks,
         CASE WHEN any_value(source_size) = 0 THEN 0.0::DOUBLE ELSE any_value(target) * CAST(sum(size) AS DOUBLE) / any_value(source_size) END AS votes
  FROM sharded GROUP BY idx, shard),
quotient AS (SELECT idx, shard, votes / (2 * k + 1) AS q FROM held, LATERAL (SELECT unnest(range(CAST(2 * blocks AS BIGINT))) AS k) WHERE votes > 0),
won AS (
  SELECT idx, shard, count(*) AS seats
  FROM (SELECT *, row_number() OVER (ORDER BY q DESC, idx, shard) AS place FROM quotient)
  WHERE place <= (SELECT floor(least({SHARE}::DOUBLE * sum(source_size), sum(most)) / {BLOCK_WORDS}.0 + 0.5) FROM cap) GROUP BY idx, shard),
plan AS (
  SELECT h.idx, h.shard, CASE WHEN blocks = 0 THEN 0 ELSE coalesce(seats, 0) // blocks END AS whole,
         CASE WHEN blocks = 0 THEN 0 ELSE coalesce(seats, 0) % blocks * {BLOCK_WORDS} END AS words
  FROM held h LEFT JOIN won USING (idx, shard)),
spread AS (SELECT *, sum(size) OVER (PARTITION BY idx, shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS until FROM sharded)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, words - (until - size))) AS BIGINT) AS taken
FROM spread JOIN plan USING (idx, shard)
"""
