"""Text search, colour filter, the visible set and pages in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.functions import score, text

SEARCHED = ("file_name", "path", "description", "keywords")


def search_text(df: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows in which every token of the query is in at least one column, as a substring without regard to case.

    An empty query finds nothing; null columns hold no token. One scan: the filter runs inside generated code.
    """
    return df.where(text.matches_all_tokens([F.col(c) for c in columns], query))


def color_filter(df: DataFrame, color: tuple[int, int, int], tolerance: float = 0.22, column: str = "dominant") -> DataFrame:
    """Rows whose dominant colour is within the tolerance (0.03 to 0.70) of a colour."""
    wanted = F.struct(*[F.lit(v).alias(c) for v, c in zip(color, "rgb")])
    return df.where(score.redmean_distance(wanted, F.col(column)) <= min(max(tolerance, 0.03), 0.70))


def visible(
    catalog: DataFrame, results: DataFrame | None = None, members: DataFrame | None = None, query: str = "", color: tuple[int, int, int] | None = None, tolerance: float = 0.22
) -> DataFrame:
    """The rows to show: similarity results if there are any, else the catalog; then collection, text and colour filters.

    An empty query doesn't filter here. ``members`` has the paths of a collection.
    """
    rows = catalog if results is None else results
    if query.split():
        rows = search_text(rows, query)
    if color is not None:
        rows = color_filter(rows, color, tolerance)
    return rows if members is None else rows.join(members.select("path").distinct(), "path", "left_semi")


def _substrings(folded: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.substr(folded, i, F.lit(3)))


def trigram_postings(df: DataFrame, id_column: str, columns: tuple[str, ...]) -> DataFrame:
    """(trigram, row_id): every folded three-character substring of each row's columns, once a row."""
    grams = []
    for c in columns:
        folded = text.nocase(F.coalesce(F.col(c).cast("string"), F.lit("")))
        places = F.when(F.length(folded) >= 3, F.sequence(F.lit(1), F.length(folded) - 2)).otherwise(F.array().cast("array<int>"))
        grams.append(_substrings(folded, places))
    return df.select(F.col(id_column).alias("row_id"), F.explode(F.array_distinct(F.concat(*grams))).alias("trigram")).select("trigram", "row_id")


def search_postings(df: DataFrame, postings: DataFrame, id_column: str, token: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows that hold the token: those with all its trigrams, then checked. The token has three characters or more."""
    folded = text.fold(token)
    grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    if not grams:
        raise ValueError("a token of three characters or more is needed")
    hits = postings.where(F.col("trigram").isin(grams)).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    found = df.join(hits.select(F.col("row_id").alias(id_column)), id_column, "left_semi")
    return found.where(text.matches_all_tokens([F.col(c) for c in columns], token))


def page_after(df: DataFrame, key: str, cursor: str | None, limit: int, ignore_case: bool = False) -> DataFrame:
    """The next ``limit`` rows in key order after the cursor."""
    k: Column = text.nocase(F.col(key)) if ignore_case else F.col(key)
    rows = df if cursor is None else df.where(k > F.lit(text.fold(cursor) if ignore_case else cursor))
    return rows.orderBy(k, key).limit(max(limit, 1))


def ordered_by_name(df: DataFrame, name: str = "file_name", tie: str = "path") -> DataFrame:
    """Rows by name without regard to case; equal names by the tie column."""
    return df.orderBy(text.nocase(F.col(name)), tie)
