"""Record linkage: name completion and canonical accents, citation tags, nearest strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import initial_periods, mapped, remove_accents, spaced_initials, without_dots
from folio.functions.udf import tex_to_unicode
from folio.operators.library import split_authors
from folio.operators.stats import accent_groups, distinct_authors

SUFFIXES = ["", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def extensions(keys: DataFrame, queries: DataFrame | None = None, column: str = "name") -> DataFrame:
    """query, name: every key that a query is a prefix of, itself included; found by equality on prefixes."""
    own = keys.select(F.col(column).alias("name")).where("name is not null").distinct()
    asked = (queries if queries is not None else keys).select(F.col(column).alias("query")).where("query is not null").distinct()
    spread = own.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substring("name", F.lit(1), i))).alias("query")).where("name <> ''")
    blank = own.where("name = ''").select("name", F.lit("").alias("query"))
    return spread.union(blank).join(asked, "query").select("query", "name")


def completions(keys: DataFrame, queries: DataFrame | None = None, column: str = "name") -> DataFrame:
    """query, longest: the longest key K that a query leads to without a choice; the query itself if no key extends it.

    That is: every key that extends the query is a prefix of K or extends K. Each key's prefixes
    are rows with the number of keys below them; a prefix leads to K if the keys between the two
    and those below K are all that are below the prefix. So rows grow with the keys' characters
    only: no group is gathered, and neither queries nor keys are listed in pairs.
    """
    own = keys.select(F.col(column).alias("name")).where("name is not null").distinct()
    asked = (queries if queries is not None else keys).select(F.col(column).alias("query")).where("query is not null").distinct()
    cuts = own.where("name <> ''").select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substring("name", F.lit(1), i))).alias("at", "prefix"))
    below = cuts.groupBy("prefix").agg(F.count("*").alias("below"), F.max(F.col("name") == F.col("prefix")).alias("key"))
    # of a key's own prefixes: how many keys there are from each of them down to the key
    chain = Window.partitionBy("name").orderBy(F.desc("at"))
    found = cuts.join(below, "prefix").withColumns({
        "between": F.count_if("key").over(chain) - 1,
        "under": F.first("below").over(chain),
    })
    good = found.where("between + under = below")
    best = good.groupBy(F.col("prefix").alias("query")).agg(F.max(F.struct(F.char_length("name").alias("n"), "name")).alias("best"))
    return asked.join(best, "query", "left").select("query", F.coalesce("best.name", "query").alias("longest"))


def author_map(refs: DataFrame, column: str = "author", by_hand: dict[str, str] | None = None) -> DataFrame:
    """original, unicoded, spaced, longest, accents, proposed, undecoded: each author's name and its way to a canonical form."""
    names = distinct_authors(refs, column).select(F.col(column).alias("original"))
    decoded = names.withColumn("__d", tex_to_unicode(F.col("original"), by_hand)).withColumn("unicoded", without_dots(F.col("__d.text")))
    spaced = decoded.select("original", "unicoded", spaced_initials(F.col("unicoded")).alias("spaced"), F.col("__d.undecoded").alias("undecoded"))
    longest = completions(spaced.select(F.col("spaced").alias("name")))
    joined = spaced.join(longest, F.col("spaced") == F.col("query")).drop("query")
    best = accent_groups(joined, "longest").select("bare", "accented")
    # only the unaccented form itself is replaced
    out = joined.join(best, F.col("longest") == F.col("bare"), "left").withColumn("accents", F.coalesce("accented", "longest"))
    return out.select("original", "unicoded", "spaced", "longest", "accents", initial_periods(F.col("accents")).alias("proposed"), "undecoded")


def mapped_authors(refs: DataFrame, names: DataFrame, key: str, column: str = "author", overrides: dict[str, str] | None = None) -> DataFrame:
    """refs with each name of its list replaced by its proposed form, in the same order."""
    parts = refs.select(key, F.posexplode(split_authors(F.col(column))).alias("at", "original")).withColumn("original", F.trim("original"))
    proposed = names.select("original", "proposed")
    found = parts.join(proposed, "original", "left").withColumn("name", F.coalesce("proposed", "original"))
    if overrides:
        found = found.withColumn("name", mapped(F.col("name"), overrides))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["name"]), " and ").alias("__list"))
    return refs.join(lists, key, "left").withColumn(column, F.coalesce("__list", column)).drop("__list").select(*refs.columns)


def canonical_names(names: DataFrame, column: str = "name") -> DataFrame:
    """name, canonical: a name without accents becomes the accented form that also occurs."""
    best = accent_groups(names, column).select("bare", "accented")
    return names.select(F.col(column).alias("name")).distinct().join(best, F.col("name") == F.col("bare"), "left").select("name", F.coalesce("accented", "name").alias("canonical"))


def surname(c: Column) -> Column:
    """The first name's part before the comma, fit for a tag."""
    return F.regexp_replace(F.trim(F.get(F.split(remove_accents(F.coalesce(c, F.lit(""))), ",", 2), F.lit(0))), r"[ .{}\-']", "")


def tag_base(author: Column, editor: Column, year: Column) -> Column:
    """Surname and year of the first author, or else of the first editor, or else NOTAG; YYYY where no year of four digits ends it.

    Name and year are taken as they are, so a name without a year keeps all its letters.
    """
    a, e, y = surname(author), surname(editor), F.coalesce(year.cast("string"), F.lit(""))
    stem = F.when(a != "", F.concat(a, y)).when(e != "", F.concat(e, y)).otherwise("NOTAG")
    return F.when(stem.rlike("[0-9]{4}$"), stem).otherwise(F.concat(stem, F.lit("YYYY")))


def _suffix(rank: Column) -> Column:
    """'', a to z, A to Z, then numbers from 53."""
    return F.when(rank < len(SUFFIXES), F.get(F.array(*map(F.lit, SUFFIXES)), rank)).otherwise(rank.cast("string"))


def _bases(tags: DataFrame, column: str) -> DataFrame:
    """base, suffix for every way a tag can be a base and a suffix: nothing, a letter, or a number from 53."""
    t = F.col(column)
    digits = F.char_length(F.regexp_extract(t, "([0-9]*)$", 1))
    numbers = F.filter(F.transform(F.sequence(F.lit(0), digits), lambda n: F.right(t, n)), lambda d: (F.char_length(d) >= 2) & (F.left(d, F.lit(1)) != "0") & (F.coalesce(d.try_cast("bigint"), F.lit(0)) >= len(SUFFIXES)))
    letter = F.regexp_extract(t, "[A-Za-z]$", 0)
    endings = F.concat(F.array(F.lit("")), F.when(letter != "", F.array(letter)).otherwise(F.array().cast("array<string>")), numbers)
    return tags.select(t, F.explode(endings).alias("suffix")).select(F.left(t, F.char_length(t) - F.char_length("suffix")).alias("base"), "suffix").distinct()


def _slot(suffix: Column) -> Column:
    """The place of a suffix among all suffixes, from 0."""
    return F.coalesce(suffix.try_cast("bigint"), F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix) - 1)


def ranks(rows: DataFrame, group: str, order: str, name: str, per_range: int = 200_000) -> DataFrame:
    """rows with their place in their group, from 0, by a numeric column.

    Rows are numbered within a group's part in each range of the order (approximate quantiles of all
    rows), and the sizes of a group's earlier parts are added: a group may hold any share of the
    rows without its rows meeting in one task. Small tables are one range. An order that isn't
    numeric is one range too.
    """
    own = Window.partitionBy(group)
    if dict(rows.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return rows.withColumn(name, F.row_number().over(own.orderBy(order)).cast("long") - 1)
    parts = min(2000, rows.count() // per_range)
    if parts <= 1:
        return rows.withColumn(name, F.row_number().over(own.orderBy(order)).cast("long") - 1)
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"] or []))
    at = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))))
    ranged = rows.withColumn("__range", at)
    sizes = ranged.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__group", "__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inner = ranged.withColumn("__place", F.row_number().over(Window.partitionBy(group, "__range").orderBy(order)) - 1)
    joined = inner.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at")))
    return joined.withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__group", "__at", "__before", "__place")


def allocate_tags(rows: DataFrame, base: str, order: str, existing: DataFrame | None = None, name: str = "tag", per_range: int = 200_000) -> DataFrame:
    """rows with a unique tag each: the base, then the base with the next free suffix, in the given order.

    Suffixes that existing tags (column `tag`) have taken are stepped over. The j-th taken slot of
    a base, less j, is the number of free slots before it; merged in that order with the rows'
    ranks, taken first, each row's place in its base is the slot it gets. No slots are listed, and
    a base may have any number of rows.
    """
    ranked = ranks(rows, base, order, "__rank", per_range)
    if existing is None:
        return ranked.withColumn(name, F.concat(F.col(base), _suffix(F.col("__rank")))).drop("__rank")
    wanted = rows.select(F.col(base).alias("__b")).distinct()
    taken = _bases(existing.select("tag").where("tag is not null").distinct(), "tag").select(F.col("base").alias("__b"), _slot(F.col("suffix")).alias("slot")).join(wanted, "__b", "left_semi")
    taken = ranks(taken, "__b", "slot", "__j", per_range).select("__b", ((F.col("slot") - F.col("__j")) * 2).alias("__pos"))
    own = ranked.select(F.col(base).alias("__b"), (F.col("__rank") * 2 + 1).alias("__pos"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    placed = ranks(own.unionByName(taken, allowMissingColumns=True), "__b", "__pos", "__slot", per_range).where("__row is not null")
    return placed.select("__row.*", F.concat(F.col("__b"), _suffix(F.col("__slot"))).alias(name))


def next_tags(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """base, next_tag for each base: itself if it is free, or else the first suffix after the last one in use."""
    own = wanted.select("base").distinct()
    used = _bases(tags, "tag").withColumn("at", _slot(F.col("suffix"))).groupBy("base").agg(F.max("at").alias("at"))
    return own.join(used, "base", "left").select("base", F.concat("base", F.when(F.col("at").isNull(), F.lit("")).otherwise(_suffix(F.col("at") + 1))).alias("next_tag"))


def nearest_strings(missing: DataFrame, known: DataFrame, sample: int = 8) -> DataFrame:
    """missing, match, distance: for each string not among the known, the known one at the least edit distance, ties to the smallest.

    A few likely matches (same end, same start) bound the distance first; strings whose lengths
    differ by more than the bound can't be nearer, so the exact search joins on lengths and stops
    each comparison at the bound. Columns are `missing` and `known`.
    """
    have = known.select("known").where("known is not null").distinct()
    lost = missing.select("missing").where("missing is not null").distinct().join(have, F.col("missing") == F.col("known"), "left_anti")
    def ends(c: str) -> Column:
        return F.explode(F.array(F.concat(F.lit("e"), F.right(F.col(c), F.lit(6))), F.concat(F.lit("s"), F.left(F.col(c), F.lit(6)))))
    some = have.select("known", ends("known").alias("key")).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("known"))).where(F.col("n") <= sample)
    likely = lost.select("missing", ends("missing").alias("key")).join(some, "key").groupBy("missing").agg(F.min(F.levenshtein("missing", "known")).alias("bound"))
    any_ = have.select("known").orderBy("known").limit(1).select(F.col("known").alias("any"))
    bounded = lost.join(likely, "missing", "left").join(F.broadcast(any_), how="left").withColumn("bound", F.coalesce("bound", F.levenshtein("missing", "any"))).where("bound is not null")
    spread = bounded.select("missing", "bound", F.explode(F.sequence(F.greatest(F.lit(0), F.char_length("missing") - F.col("bound")), F.char_length("missing") + F.col("bound"))).alias("length"))
    pairs = spread.join(have.withColumn("length", F.char_length("known")), "length").withColumn("distance", F.expr("levenshtein(missing, known, bound)")).where("distance >= 0")
    return pairs.groupBy("missing").agg(F.min(F.struct("distance", "known")).alias("best")).select("missing", F.col("best.known").alias("match"), F.col("best.distance").alias("distance"))


def file_fields(refs: DataFrame, key: str = "tag", column: str = "file") -> tuple[DataFrame, DataFrame]:
    """(tag, drive, vfile, type) of each item with four parts by colons, and (tag, item) of the others that aren't empty."""
    items = refs.select(key, F.explode(F.split(F.col(column), ";")).alias("item")).withColumn("p", F.split("item", ":"))
    good = items.where(F.size("p") == 4).select(key, F.get("p", F.lit(1)).alias("drive"), F.get("p", F.lit(2)).alias("vfile"), F.get("p", F.lit(3)).alias("type"))
    return good, items.where((F.size("p") != 4) & (F.col("item") != "")).select(key, "item")


def missing_files(proto: DataFrame, doc: DataFrame) -> DataFrame:
    """(tag, vfile) of referenced files that aren't among the documents."""
    return proto.join(doc.select(F.col("path").alias("vfile")), "vfile", "left_anti").select("tag", "vfile")


def linked_files(proto: DataFrame, doc: DataFrame) -> DataFrame:
    """tag, path: the files that references name, or the nearest ones that exist."""
    known = doc.select(F.col("path").alias("known"))
    near = nearest_strings(proto.select(F.col("vfile").alias("missing")), known).select(F.col("missing").alias("vfile"), "match")
    return proto.join(near, "vfile", "left").select("tag", F.coalesce("match", "vfile").alias("path"))


def with_hashes(doc: DataFrame, index: DataFrame) -> DataFrame:
    """doc with the hash that another index (path, hash) has for its path, slashes made even; null without one."""
    def even(c: str) -> Column:
        return F.lower(F.regexp_replace(F.col(c), r"[/\\]+", "/"))
    other = index.select(even("path").alias("__path"), F.col("hash").alias("__hash")).groupBy("__path").agg(F.min("__hash").alias("__hash"))
    return doc.drop("hash").join(other, even("path") == F.col("__path"), "left").withColumnRenamed("__hash", "hash").drop("__path")
