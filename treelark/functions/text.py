"""Column functions on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), the value computed once however often fn has it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def normalise_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pattern_of(quote: Column) -> Column:
    """A regular expression that finds a quote whatever white space stands between its words."""
    escaped = F.regexp_replace(normalise_ws(quote), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_replace(escaped, " ", r"\\s+")


def find_span(text: Column, quote: Column) -> Column:
    """Where a quote stands in a text, tolerant to runs of white space: struct(start 0-based, end), or null."""
    at = F.regexp_instr(text, pattern_of(quote))
    found = F.regexp_substr(text, pattern_of(quote))
    ok = (normalise_ws(quote) != "") & (at > 0)
    return F.when(ok, F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(found)).cast("long").alias("end")))


def contains_quote(text: Column, quote: Column) -> Column:
    return F.coalesce((normalise_ws(quote) != "") & (F.instr(normalise_ws(text), normalise_ws(quote)) > 0), F.lit(False))


def split_context(contextualized: Column, verbatim: Column) -> Column:
    """struct(breadcrumb, text): the bracketed first line and the rest if the rest is the verbatim text."""
    at = F.instr(contextualized, "]\n")
    rest = F.substr(contextualized, at + 2)
    bracketed = contextualized.startswith("[") & (at > 0) & (rest == verbatim)
    same = F.coalesce((contextualized == verbatim) | (F.trim(contextualized) == ""), F.lit(True))
    crumb = F.when(~same & bracketed, F.substr(contextualized, F.lit(2), at - 2)).otherwise("")
    body = F.when(same, verbatim).when(bracketed, rest).otherwise(contextualized)
    return F.struct(crumb.alias("breadcrumb"), body.alias("text"))


def trigrams(text: Column) -> Column:
    """The set of trigrams of the words of a text, each padded by two spaces in front and one behind."""
    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda k: F.substr(padded, k, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def grams(text: Column) -> Column:
    """The set of runs of three characters of a text in lower case, across words; empty for shorter texts. Linear in its length."""
    runs = lambda ls: F.transform(ls, lambda c, i: F.concat(c, F.get(ls, i + 1), F.get(ls, i + 2)))
    found = F.get(F.transform(F.array(F.split(F.lower(text), "")), runs), F.lit(0))  # the letters are bound, not split anew for each of them
    return F.array_distinct(F.filter(found, lambda g: g.isNotNull() & (F.length(g) == 3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def word_similarity(query: Column, text: Column) -> Column:
    """The best trigram similarity of a query with a run of as many consecutive words of a text."""
    q, words = trigrams(query), tokens(text)
    n = F.greatest(F.size(tokens(query)), F.lit(1))

    def score(k: Column) -> Column:
        t = trigrams(F.array_join(F.slice(words, k, n), " "))
        return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(F.array_union(q, t))), F.lit(0.0))

    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), score)))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def harmonic2(tf: Column) -> Column:
    """The sum of 1 / j^2 for j up to tf."""
    return F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j))
