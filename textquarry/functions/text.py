"""Text expressions: tokenizers, shingles, hashes, snippets. All are built-in expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .modular import MERSENNE_61

# The English stop words, dropped wherever content tokens are asked for.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below
    between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each
    few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
    herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more
    most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same
    shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
    then there there's these they they'd they'll they're they've this those through to too under until up very
    was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's
    whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)


def identifier_tokens(text: Column) -> Column:
    """Sub-identifier tokens: camel and snake case parts, lower-cased one by one, digits kept with letters."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z0-9])", "$1 $2")
    return F.transform(F.coalesce(F.regexp_extract_all(apart, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.array().cast("array<string>")), F.lower)


def space_words(text: Column) -> Column:
    """Words between white space; none for blank or null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)), F.array().cast("array<string>"))


def lower_words(text: Column) -> Column:
    return space_words(F.lower(text))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script, longer than one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.length(t) > 1)


def content_tokens(tokens: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens of more than one letter that are no stop words."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct n-word shingles in order; texts of fewer words give their words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, grams).otherwise(words))


def hash60(value: Column) -> Column:
    """60 bits of an md5, the same in any engine."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def unit_hash(*parts: Column) -> Column:
    """0 to 1 by the md5 of parts joined with colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def snippet(text: Column, size: int = 120) -> Column:
    """One line of at most `size` characters and an ellipsis."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def pad_truncate(values: Column, size: int, filler: int = 0) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler).cast("long"), size)), 1, size)


def minhash_coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """Multipliers and offsets modulo 2^61 - 1, from md5 of the seed and their place."""
    import hashlib

    p = MERSENNE_61
    value = lambda s: int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:16], 16) % p
    return [(1 + value(f"a{i}") % (p - 1), value(f"b{i}")) for i in range(n)]
