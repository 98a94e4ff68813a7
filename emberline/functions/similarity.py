"""String similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _once(f, *values: Column) -> Column:
    """``f`` of values that are computed once a row, however often ``f`` and the lambdas in it use them."""
    held = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(held), lambda s: f(*(s[f"v{i}"] for i in range(len(values)))))[0]


def grams(s: Column, n: int) -> Column:
    """All character n-grams in order, repeats kept."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of bigrams of two strings; 0 if neither has one."""
    times = lambda arr, g: F.size(F.filter(arr, lambda z: z == g))

    def of(x: Column, y: Column) -> Column:
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
        return F.coalesce(2.0 * shared / F.nullif(F.size(x) + F.size(y), F.lit(0)), F.lit(0.0))

    return _once(of, grams(a, 2), grams(b, 2))


def alias_similarity(a: Column, b: Column) -> Column:
    """Dice of normalised names; 1 if equal, 0.94 if one contains the other, 0 if either is empty."""
    of = lambda x, y: F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.94).otherwise(dice(x, y))
    return _once(of, norm_name(a), norm_name(b))


def name_similarity(a: Column, b: Column) -> Column:
    """The greater of bigram Dice and word Jaccard; 0.92 if a name of six letters or more is contained in the other."""

    def of(x: Column, y: Column) -> Column:
        inside = ((F.length(x) >= 6) & y.contains(x)) | ((F.length(y) >= 6) & x.contains(y))
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, 0.92).otherwise(F.greatest(dice(x, y), _shared_words(x, y, 2)))

    return _once(of, norm_name(a), norm_name(b))


def _shared_words(x: Column, y: Column, least: int) -> Column:
    """Jaccard similarity of the words of at least so many letters; 0 if there are none."""
    words = lambda s: F.array_distinct(F.filter(F.split(s, " "), lambda w: F.length(w) >= least))
    of = lambda u, v: F.coalesce(F.size(F.array_intersect(u, v)) / F.nullif(F.size(F.array_union(u, v)), F.lit(0)), F.lit(0.0))
    return _once(of, words(x), words(y))


def registry_similarity(a: Column, b: Column) -> Column:
    """Jaccard of words of three letters and more; 1 if equal, 0.94 if a name of eight letters or more is contained in the other."""

    def of(x: Column, y: Column) -> Column:
        inside = ((F.length(x) >= 8) & y.contains(x)) | ((F.length(y) >= 8) & x.contains(y))
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, 0.94).otherwise(_shared_words(x, y, 3))

    return _once(of, norm_name(a), norm_name(b))


def trigrams(c: Column) -> Column:
    """The set of trigrams of each word, lower-cased and padded with two blanks before and one after."""
    words = F.filter(F.array_distinct(F.split(norm_name(c), " ")), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    three = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, three)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays without repeats; 0 if both are empty."""
    of = lambda x, y, shared: F.coalesce(shared / F.nullif(F.size(x) + F.size(y) - shared, F.lit(0)), F.lit(0.0))
    return _once(lambda x, y: _once(lambda shared: of(x, y, shared), F.size(F.array_intersect(x, y))), a, b)


def trgm_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets."""
    return set_similarity(trigrams(a), trigrams(b))
