"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

Every shingle hash below a fixed fraction of the hash range is kept. The rule doesn't depend on
the document, so sketches of parts merge by union, and the share of one sketch that is in another
estimates containment even where one document is far longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import SPACE, longs, ranges, table

WORDS = 5
#: Hashes with so many leading zero bits are kept: a fraction of 1/4.
ZEROS = 2
BLANK = " \t\n\x0b\f\r"


def lowered_words(text: Column) -> Column:
    """Lower-case words; one empty word for empty and blank texts."""
    return F.split(F.btrim(F.lower(text), F.lit(BLANK)), SPACE)


def shingle_sketch(text: Column, size: int = WORDS, zeros: int = ZEROS) -> Column:
    """Sorted distinct shingle hashes below 2^(64 - zeros); a text with fewer words is one shingle.

    The hash of a shingle is XXH64 over the XXH64 of its words. Null text gives null.
    """
    hashed = F.transform(lowered_words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) >= size, many).otherwise(F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))

    # bound to a lambda's variable, so that the words are hashed once and not once a shingle
    kept = F.transform(F.array(hashed), lambda h: F.filter(shingles(h), lambda x: F.shiftrightunsigned(x, 64 - zeros) == 0))
    return F.sort_array(F.array_distinct(F.get(kept, F.lit(0))))


def whole_hash(text: Column) -> Column:
    """One hash of all words: texts too short for the sketch are still told apart."""
    return F.xxhash64(F.concat_ws(" ", lowered_words(text)))


def likeness(hash_a: Column, a: Column, hash_b: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 1 for equal word sequences, 0 for two empty sketches of different ones."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(hash_a == hash_b, 1.0).when(either == 0, 0.0).otherwise(shared / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that are in b; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    return F.sort_array(F.array_union(a, b))


def as_text(hashed: Column, sketched: Column) -> Column:
    """The whole hash, a colon and the sketch's hashes in 16 hex digits each."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(digits(hashed), F.lit(":"), F.array_join(F.transform(sketched, digits), ""))


def with_next(docs: DataFrame, key: str, columns: list[str], ties: str, rows: int = 2048) -> DataFrame:
    """docs with next_<column>: that of the next row in descending key order, after the last row the first one's.

    Rows are ordered inside ranges of the key. The first rows of each range are also dealt to the
    range that comes before it, so no task needs more than its own range. Equal keys are ordered
    by the hash of `ties`, by which a key that many rows have falls into many ranges, and then by
    `ties`; null keys come last.
    """
    docs = docs.withColumn("__tie", F.xxhash64(ties))
    part = docs.withColumn("__range", ranges(docs.select(key, "__tie"), key, F.col("__tie"), rows))
    heads = part.groupBy("__range").agg(F.max(key).alias("head")).orderBy(F.desc("__range")).collect()
    if not heads:
        return docs.drop("__tie").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = {r["__range"]: heads[i - 1]["__range"] for i, r in enumerate(heads)}
    size = heads[0]["__range"] + 1
    at = {r["__range"]: r["head"] for r in heads}
    head_of = F.get(longs([at.get(i) if at.get(i) is not None else -(1 << 63) for i in range(size)]), F.col("__range"))
    to = F.get(longs([before.get(i, 0) for i in range(size)]), F.col("__range")).cast("int")
    is_head = F.coalesce(F.col(key), F.lit(-(1 << 63))) == head_of
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("late"))
    dealt = part.withColumn("__to", F.explode(F.when(is_head, F.array(own, F.struct(to.alias("range"), F.lit(1).alias("late")))).otherwise(F.array(own))))
    dealt = dealt.withColumns({"__range": F.col("__to.range"), "__late": F.col("__to.late")})
    order = Window.partitionBy("__range").orderBy("__late", F.desc_nulls_last(key), F.desc("__tie"), ties)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.where("__late = 0").drop("__range", "__late", "__to", "__tie")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's sketch beside that of an edited text, whose last third is the next document's start.

    doc_id, n_chars (code points), text, edited, and hash and sketch of the text, of the edited
    text and of the next document's text. A null text is empty. Repeated doc_ids are ordered by
    a hash of their text; rows with a null doc_id come after all others. A lone document is its own next.
    An empty table gives an empty result; other columns aren't read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"hash": whole_hash(F.col("text")), "sketch": shingle_sketch(F.col("text"))})
    both = with_next(own, "doc_id", ["text", "hash", "sketch"], "text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "hash", "sketch", "next_hash", "next_sketch")
    return out.withColumns({"edited_hash": whole_hash(F.col("edited")), "edited_sketch": shingle_sketch(F.col("edited"))})


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("hash"), F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_hash"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("hash"), F.col("sketch"), F.col("edited_hash"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("hash"), F.col("sketch"), F.col("next_hash"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"), containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in"),
    )
