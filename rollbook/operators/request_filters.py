"""Many filters against many rows at once: filters are rows, and no filter becomes a Column of the plan.

A row matches a filter when as many of the filter's equalities and memberships hit it as the filter has. To get there without comparing all with all,
each filter is looked up by the one column whose values fewest rows have; only rows found that way are counted through. Filters that ask
for the same are answered once, and rows alike in all columns that filters ask about are judged once, as one kind. Texts are told apart
only for the filters that have a keyword. Counts and extremes are summed up from asks and kinds, so they need no pair of a filter and a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join
from rollbook.operators.keyword_search import like_pattern, search_keywords
from rollbook.operators.tables import kept

TERMS = "array<struct<column:string,values:array<string>>>"


@dataclass
class Matched:
    """``rows`` pairs filters with the keys of rows, ``counts`` has a row for each filter, ``rejected`` tells why a filter is refused.

    ``chosen`` has a row for each key that any filter chooses: how many ``filters`` do, the ``first_filter`` and the ``last_filter``.
    """

    rows: DataFrame
    counts: DataFrame
    rejected: DataFrame
    chosen: DataFrame


def match_filters(filters: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], filter_id: str = "filter_id") -> Matched:
    """Which rows each filter chooses, and how many.

    Filters have ``filter_id``, ``terms`` (a map from column to its allowed values, as text), ``keyword`` and ``match_range`` (the columns
    it is searched in). All terms must hit, and the keyword must be in one of its columns, as a listing's ``LIKE`` finds it. As in listings a
    ``_list`` suffix is cut, a term without a list or with an empty one filters nothing, spaces are taken out of keywords, and a
    keyword without text or columns filters nothing. Values are read as the type of their column; one that can't be, and a NULL, hit nothing. Rows with one
    filter id are alternatives: what any of them chooses is chosen, once.

    ``columns`` are those a filter may name. A filter that names another is refused as ``unknown_column``, one without an id as ``no_id``. Rows
    have a unique ``key``; those without one are left out.
    """
    columns = list(columns)
    given = filters.select(F.col(filter_id).alias("filter_id"), _terms(rows, columns).alias("terms"), *_keyword())
    named = F.array_union(F.transform("terms", lambda t: t["column"]), F.coalesce("match_range", F.array().cast("array<string>")))
    bad = F.size(F.array_except(named, F.array(*map(F.lit, columns)))) > 0
    one = F.struct("terms", "keyword", "match_range")
    asked = given.where("filter_id is not null").groupBy("filter_id").agg(F.array_sort(F.collect_set(one)).alias("_any"), F.max(bad).alias("_bad"))
    # an alternative that filters nothing makes all others idle, so filters that choose every row ask for the same
    idle = F.filter("_any", lambda a: (F.size(a["terms"]) == 0) & a["keyword"].isNull())
    asked = asked.withColumn("_any", F.when(F.size(idle) > 0, idle).otherwise(F.col("_any")))
    asked = kept(asked.withColumn("_asks", F.sha2(F.to_json("_any"), 256)), "filters")
    sound = asked.where("not _bad")
    firsts = sound.groupBy("_asks").agg(F.min("filter_id").alias("filter_id"))
    worded = F.exists("_any", lambda a: a["keyword"].isNotNull()).alias("_worded")
    ways = left_join(sound, firsts, ["_asks", "filter_id"], "left_semi").select("_asks", worded, F.posexplode("_any").alias("_way", "_one"))
    ways = kept(ways.select("_asks", "_worded", "_way", "_one.*"), "filter-ways")

    kinds = kept(_kinds(ways, rows, key, columns), "filter-kinds")
    sizes = kinds.groupBy("_worded", "_kind", "_alike").agg(F.count(F.lit(1)).alias("_n"))
    held = sizes.select("_worded", "_kind", F.explode("_alike").alias("_row")).withColumn("_row", _values(columns))
    found = [_by_terms(ways, held), _by_keyword(ways, held, columns), _by_nothing(ways, held)]
    pairs = kept(reduce(DataFrame.unionByName, [f for f in found if f is not None]).distinct(), "filter-pairs")
    told, place = sound.select("filter_id", "_asks"), kinds.select("_kind", "key")
    matches = left_join(pairs, sizes.select("_kind", "_n"), ["_kind"], "inner").groupBy("_asks").agg(F.sum("_n").alias("matches"))
    extremes = [F.min("first_filter").alias("first_filter"), F.max("last_filter").alias("last_filter")]
    askers = told.groupBy("_asks").agg(F.count(F.lit(1)).alias("filters"), F.min("filter_id").alias("first_filter"), F.max("filter_id").alias("last_filter"))
    of_kind = left_join(pairs, askers, ["_asks"], "inner").groupBy("_kind").agg(F.sum("filters").alias("filters"), *extremes)
    chosen = left_join(place, of_kind, ["_kind"], "inner").groupBy("key").agg(F.sum("filters").alias("filters"), *extremes)
    return Matched(
        left_join(left_join(told, pairs, ["_asks"], "inner"), place, ["_kind"], "inner").select("filter_id", F.col("key").alias(key)),
        left_join(told, matches, ["_asks"]).select("filter_id", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches")),
        asked.where("_bad").select("filter_id", F.lit("unknown_column").alias("reason")).unionByName(
            given.where("filter_id is null").select("filter_id", F.lit("no_id").alias("reason"))
        ),
        chosen.select(F.col("key").alias(key), "filters", "first_filter", "last_filter"),
    )


def _kinds(ways: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The kind of every key, once for the filters without keywords and, if there are any, once for those that have one.

    ``_alike`` holds what the key's rows have in the columns that these filters ask about; as a text, ``_kind``, it tells kinds apart.
    """
    asked = F.array_union(F.transform("terms", lambda t: t["column"]), F.coalesce("match_range", F.array().cast("array<string>")))
    used = {tuple(r) for r in ways.select("_worded", F.explode(asked)).distinct().collect()}  # no more than twice the columns
    parts = []
    for worded in sorted({False} | {w for w, _ in used}):
        fields = [F.when(F.lit((worded, c) in used), F.col(c).cast("string")).alias(f"_c{i}") for i, c in enumerate(columns)]
        own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*fields).alias("_one"))
        own = own.groupBy("key").agg(F.array_sort(F.collect_set("_one")).alias("_alike"))
        parts.append(own.select("key", F.lit(worded).alias("_worded"), "_alike", F.concat(F.lit(f"{worded:d}"), F.to_json("_alike")).alias("_kind")))
    return reduce(DataFrame.unionByName, parts)


def _terms(rows: DataFrame, columns: list[str]) -> Column:
    """Terms that filter, in one order, with values as the column's type writes them."""
    kinds = {c: rows.schema[c].dataType for c in columns}

    def read(column: Column, value: Column) -> Column:
        return reduce(lambda when, c: when.when(column == c, value.try_cast(kinds[c]).cast("string")), columns, F.when(F.lit(False), value))

    def term(entry: Column) -> Column:
        column = F.regexp_replace(entry["key"], "_list$", "")
        values = F.transform(entry["value"], lambda v: read(column, v))
        return F.struct(column.alias("column"), F.array_sort(F.array_distinct(F.array_compact(values))).alias("values"))

    filtering = F.filter(F.map_entries("terms"), lambda e: F.coalesce(F.size(e["value"]) > 0, F.lit(False)))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(filtering, term))), F.array().cast(TERMS))


def _keyword() -> list[Column]:
    """Keyword and the columns it is searched in, both NULL if there is nothing to search."""
    word = F.replace(F.col("keyword"), F.lit(" "), F.lit(""))
    within = F.array_sort(F.array_distinct(F.array_compact("match_range")))
    asked = (word != "") & (F.size(within) > 0)
    return [F.when(asked, word).alias("keyword"), F.when(asked, within).alias("match_range")]


def _values(columns: list[str]) -> Column:
    """A kind's values by column, as text, without NULLs."""
    whole = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(f"_row._c{i}") for i in range(len(columns))]))
    return F.map_filter(whole, lambda c, v: v.isNotNull())


def _hits() -> Column:
    """Whether a candidate's row is hit by every term and by the keyword."""
    hit = F.filter("terms", lambda t: F.array_contains(t["values"], F.col("_row")[t["column"]]))
    said = F.exists("match_range", lambda c: F.like(F.col("_row")[c], like_pattern(F.col("keyword"))))
    return (F.size(hit) == F.size("terms")) & (F.col("keyword").isNull() | said)


def _by_terms(ways: DataFrame, held: DataFrame) -> DataFrame | None:
    """Matches of filters with terms, through the column whose values fewest kinds have."""
    ways = ways.where("size(terms) > 0")
    terms = ways.select("_asks", "_worded", "_way", F.explode("terms").alias("_t")).select("_asks", "_worded", "_way", "_t.column", F.explode("_t.values").alias("value"))
    used = [r[0] for r in terms.select("column").distinct().collect()]  # no more than the rows have columns
    if not used:
        return None
    told = held.select("_worded", "_kind", "_row", F.explode(F.map_filter("_row", lambda c, v: c.isin(used))).alias("column", "value"))
    place = ["_worded", "column", "value"]
    counts = left_join(told.select(*place), terms.select(*place).distinct(), place, "left_semi").groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    costs = left_join(terms, counts, place).groupBy("_asks", "_way", "column").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    least = costs.groupBy("_asks", "_way").agg(F.min(F.struct("_n", "column")).alias("_least")).where("_least._n > 0")
    chosen = left_join(terms, least.select("_asks", "_way", F.col("_least.column").alias("column")), ["_asks", "_way", "column"], "left_semi")
    probes = left_join(chosen, ways.drop("_worded"), ["_asks", "_way"])
    postings = left_join(told, probes.select(*place).distinct(), place, "left_semi")
    return left_join(postings, probes, place, "inner").where(_hits()).select("_asks", "_kind")


def _by_keyword(ways: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame | None:
    """Matches of filters that are a keyword alone, through the keyword search."""
    words = ways.where("size(terms) = 0 and keyword is not null").drop("_worded")
    used = {c for r in words.select(F.explode("match_range")).distinct().collect() for c in r}
    if not used:
        return None
    worded = held.where("_worded").drop("_worded")
    texts = {f"_c{i}": F.col("_row")[c] for i, c in enumerate(columns) if c in used}
    found = search_keywords(words, worded.withColumns(texts), "_kind", list(texts))
    rows_found = left_join(found, worded, ["_kind"])
    return left_join(rows_found, words, ["keyword"], "inner").where(_hits()).select("_asks", "_kind")


def _by_nothing(ways: DataFrame, held: DataFrame) -> DataFrame:
    """All kinds, for the filters that choose every row; there is one way at most that does."""
    every = ways.where("size(terms) = 0 and keyword is null").select("_asks").head()
    return held.where("not _worded").select(F.lit(every["_asks"] if every else "").alias("_asks"), "_kind").where(F.lit(every is not None))
