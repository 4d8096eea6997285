"""Tokenisers: text columns to arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, MARKS, collapse

EMPTY = "cast(array() as array<string>)"


def words(x: Column) -> Column:
    """White-space words; none for null or blank text."""
    t = collapse(F.coalesce(x, F.lit("")))
    return F.when(t == "", F.expr(EMPTY)).otherwise(F.split(t, " "))


def scoring_characters(x: Column) -> Column:
    """Letters of scripts without case stand alone; a lone sentence mark is skipped; others run on through ASCII; a <tag> is one."""
    all_ = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"[{MARKS}]|<[\x21-\x7F&&[^>]]*>?|\p{{Lo}}|[^\s\p{{Z}}\p{{Lo}}\p{{Cn}}][\x21-\x7F]*"), F.lit(0))
    return F.filter(all_, lambda t: ~t.rlike(rf"^[{MARKS}]$"))


def canonical(x: Column) -> Column:
    """Caseless letters and digits one by one, other letters as words, every other sign by itself."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\p{Lo}|\p{Nd}|[\p{L}&&[^\p{Lo}]]+|[^\s\p{Z}\p{Cn}]"), F.lit(0))


def code_switch(x: Column) -> Column:
    """Han characters one by one and upper-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"[{HAN}]|[\p{{L}}\p{{N}}'&&[^{HAN}]]+"), F.lit(0)), lambda t: F.upper(t))


def han_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(rf"^[{HAN}]+$"))


def other_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(rf"[{HAN}]"))


def graphemes(x: Column) -> Column:
    """Extended grapheme clusters, blanks left out."""
    return F.filter(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\X"), F.lit(0)), lambda t: ~t.rlike(r"^(?U)\s+$"))


def code_switch_counts(x: Column) -> tuple[Column, Column]:
    """How many Han characters and how many other tokens `code_switch` gives, without making them."""
    t = F.coalesce(x, F.lit(""))
    return F.length(F.regexp_replace(t, rf"[^{HAN}]+", "")), F.size(F.regexp_extract_all(t, F.lit(rf"[\p{{L}}\p{{N}}'&&[^{HAN}]]+"), F.lit(0)))


def num_graphemes(x: Column) -> Column:
    """How many `graphemes` there are: where no character joins with others (all are below U+0300), what isn't blank."""
    t = F.coalesce(x, F.lit(""))
    # a run of plain letters gives as many clusters as characters; general punctuation but for its joiners and marks stands alone, too
    plain = ~t.rlike(r"[^\x00-\x{2FF}\x{2010}-\x{2027}]")
    return F.when(plain, F.length(F.regexp_replace(t, r"(?U)\s+", ""))).otherwise(F.size(graphemes(x)))


def bleu_13a(x: Column) -> Column:
    """The mteval-v13a tokens of the published definition."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"<skipped>|-\n", ""), "\n", " "), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"([\x7B-\x7E\x5B-\x60\x20-\x26\x28-\x2B\x3A-\x40\x2F])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return words(t)


def bleu_zh(x: Column) -> Column:
    """Han and full-width characters stand alone, the rest as 13a."""
    return bleu_13a(F.regexp_replace(F.coalesce(x, F.lit("")), r"([\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}])", " $1 "))


def fold_tokens(tokens: Column, ignore: list[str] = (), case_sensitive: bool = False, split_map: dict[str, list[str]] | None = None) -> Column:
    """Tokens as scored: upper case, ignored ones out, tags stripped, empty ones out, some replaced by several."""
    out = tokens if case_sensitive else F.transform(tokens, lambda t: F.upper(t))
    if ignore:
        out = F.filter(out, lambda t: ~t.isin(list(ignore)))
    out = F.filter(F.transform(out, lambda t: F.regexp_replace(t, r"<[^>]*(>|$)", "")), lambda t: t != "")
    if split_map:
        table = F.create_map(*[v for k, parts in split_map.items() for v in (F.lit(k), F.array(*map(F.lit, parts)))])
        out = F.flatten(F.transform(out, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
    return out


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, joined by a blank."""
    if n == 1:
        return tokens
    return F.when(F.size(tokens) < n, F.expr(EMPTY)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    )


def _is_word(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$") & ~t.rlike(r"^\p{Lo}")


def _joins(tokens: Column) -> Column:
    """Runs of 2 to 4 neighbouring words, earliest and shortest first: array of arrays."""
    n = F.size(tokens)
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: F.when(i + k - 1 <= n, F.slice(tokens, i, k))))
    )
    return F.filter(runs, lambda r: r.isNotNull() & F.forall(r, _is_word))


def repair_spacing(mine: Column, other: Column) -> Column:
    """mine, with each word of 4 letters or more that equals 2 to 4 joined neighbours of other, and isn't in other itself, cut as there."""
    table = _joins(other)

    def cut(t: Column) -> Column:
        runs = F.filter(table, lambda r: F.array_join(r, "") == t)
        fits = (F.length(t) >= 4) & _is_word(t) & ~F.array_contains(other, t)
        return F.when(fits & (F.size(runs) > 0), F.get(runs, F.lit(0))).otherwise(F.array(t))

    return F.flatten(F.transform(mine, cut))
