"""Column expressions: keys, tokens, weights and array arithmetic.  All stay inside generated code on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def tokens(text: str | Column, pattern: str = WORD) -> Column:
    """Lower-cased words of a text; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def content_key(items: Column, length: int = 16) -> Column:
    """Content-addressed identity of a bag of strings: SHA-1 of its sorted members, truncated."""
    return F.substring(F.sha1(F.array_join(F.array_sort(items), " ")), 1, length)


def set_key(items: Column, length: int = 16) -> Column:
    """As ``content_key``, blind to repeats."""
    return content_key(F.array_distinct(items), length)


def smoothed_idf(n: Column, df: Column) -> Column:
    """ln(N / (df + 1)) + 1, the weight of relations."""
    return F.log(n.cast("double") / (df + 1)) + 1


def plain_idf(n: Column, df: Column) -> Column:
    """ln(N / df), the weight of words in set similarity."""
    return F.log(n.cast("double") / df)


def tf_idf(tf: Column, n: Column, df: Column) -> Column:
    return F.log1p(tf.cast("double")) * smoothed_idf(n, df)


#: A lone secondary tie weighs log1p(c): its square is half that of a lone primary tie.
SECONDARY = 2 ** (1 / 2**0.5) - 1


def cooccurrence(primary: Column, secondary: Column, n: Column, df: Column) -> Column:
    return smoothed_idf(n, df) * F.log1p(primary + F.lit(SECONDARY) * secondary)


def masked(token: Column) -> Column:
    """References, URLs and numbers stand for no word."""
    return token.rlike(r"^(ref\d{6}|url\d{8})$") | token.rlike(r"^[\d.,%]+$")


def ladder(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """First rule that holds names the class."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def first_match(text: Column, rules: Sequence[tuple[str, object]], otherwise: object = None) -> Column:
    """Value of the first regular expression that matches, in list order."""
    return ladder([(text.rlike(p), F.lit(v)) for p, v in rules], otherwise)  # type: ignore[misc]


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def spelling_key(word: Column) -> Column:
    return F.regexp_replace(word, "_", "")


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?]+(?:\s+|$)"), lambda s: F.trim(s) != ""))


def shingles(words: Column, size: int) -> Column:
    """Distinct phrases of ``size`` words; a shorter text is one phrase, an empty one none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))


def day_of(text: Column, *more: Column) -> Column:
    """Dates like 2024 Jan 5; the first of several columns that parses."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit("yyyy MMM d"))) for c in (text, *more)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where one side has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def shares(a: Column) -> Column:
    """Non-negative entries as shares of their sum; null where that is 0."""
    s = total(a)
    return F.when(s > 0, F.transform(a, lambda x: x / s))


def entropy_bits(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (natural logarithm) of two share vectors."""
    half = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0)))


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def above_chance(x: Column, chance: Column) -> Column:
    return (x - chance) / (1 - chance)


def hash_order(key: Column, seed: str) -> Column:
    """A portable random order: MD5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
