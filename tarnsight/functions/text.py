"""Text normalisation as column expressions; nothing here leaves the JVM. Null text is null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_PUNCT = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
#: Sentence marks that the error-rate tokeniser skips, by code point.
MARKS = r"\x21\x2C\x3F\x{3001}\x{3002}\x{300A}-\x{300F}\x{FE30}\x{FF01}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF1F}"
HAN = r"\x{4E00}-\x{9FFF}"


def strip_tags(x: Column) -> Column:
    """Drop <...>; an unclosed < drops the rest."""
    return F.regexp_replace(x, r"<[^>]*(>|$)", "")


def strip_punctuation(x: Column) -> Column:
    """Remove Unicode punctuation and all ASCII signs; digits, case and spaces stay."""
    return F.regexp_replace(x, rf"[\p{{P}}{ASCII_PUNCT}]", "")


def strip_punctuation_but(x: Column, keep: str = "-./%") -> Column:
    """Remove Unicode punctuation except the signs in `keep`."""
    kept = "".join(rf"\x{{{ord(c):X}}}" for c in keep)
    return F.regexp_replace(x, rf"[\p{{P}}&&[^{kept}]]" if keep else r"\p{P}", "")


def strip_for_scoring(x: Column) -> Column:
    """Remove punctuation and whatever has no name or can't be printed; white space becomes one blank."""
    out = F.regexp_replace(x, r"[\p{Cc}\p{Cn}\p{Cs}\p{Co}&&[^\t\n\r]]", "")
    out = F.regexp_replace(out, rf"[{ASCII_PUNCT}\p{{P}}&&[^'\-]]", "")
    return collapse(out)


def collapse(x: Column) -> Column:
    """White-space runs to one blank, none at either end."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def speaker_normalise(x: Column, language: str = "en") -> Column:
    """Tags and sentence signs out (apostrophes stay), upper case, blanks collapsed; for zh each Han character stands alone."""
    out = strip_tags(x)
    out = F.regexp_replace(out, rf"[{ASCII_PUNCT}&&[^'<>]]|[\p{{P}}&&[^\x00-\x7F]]", "")
    out = F.upper(out)
    if language.startswith(("zh", "cmn", "yue")):
        out = F.regexp_replace(out, rf"([{HAN}])", " $1 ")
    return collapse(out)


def punctuation_to_space(x: Column) -> Column:
    """Signs to blanks, but for currency and percent, a point between digits, a minus before a digit; an apostrophe inside a word goes."""
    out = F.regexp_replace(x, r"(?<=\p{L})['\x{2019}](?=\p{L})", "")
    out = F.regexp_replace(out, r"[\p{Cc}\p{Cn}&&[^\s]]", "")
    sign = r"(?:(?<!\d)\.|\.(?!\d)|-(?!\d)|[\p{P}\p{S}&&[^.\-%$\x{A5}\x{B0}]])"
    return F.regexp_replace(out, sign, " ")


def basic_normalise(x: Column) -> Column:
    """Lower case, bracketed parts out, marks and signs to blanks, collapsed; `spoken.chain("basic")` also folds compatibility forms."""
    unbracketed = F.regexp_replace(F.lower(x), r"[\[<][^\]>]*[\]>]|\([^)]+\)", "")
    return collapse(F.regexp_replace(unbracketed, r"[\p{M}\p{S}\p{P}]", " "))


def visible(x: Column) -> Column:
    """Zero-width characters out; other control and separator characters, but for newline and tab, to blanks."""
    out = F.regexp_replace(x, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    return F.regexp_replace(out, r"[\p{C}\p{Z}&&[^\n\t]]", " ")


def label_value(x: Column, case_sensitive: bool = False, strip_edges: bool = True) -> Column:
    """A label as compared: trimmed, lower-cased, blanks collapsed, edge signs off."""
    out = collapse(x)
    out = out if case_sensitive else F.lower(out)
    if strip_edges:
        out = F.regexp_replace(out, rf"^[{ASCII_PUNCT}\p{{P}}\s]+|[{ASCII_PUNCT}\p{{P}}\s]+$", "")
    return out


def keyword(x: Column) -> Column:
    """Upper case without white space; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(x, r"(?U)\s+", "")), F.lit(""))


#: Letters whose upper case has several characters, and the one that stands for each in a mapping of single characters.
_ONE_UPPER = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1 and c != "\u00DF"}


def upper_each(x: Column) -> Column:
    """Upper case character by character, as SQL engines without full case mapping have it: \u00DF becomes \u1E9E, not SS; a ligature stays."""
    x = F.replace(x, F.lit("\u00DF"), F.lit("\u1E9E"))
    odd = "".join(_ONE_UPPER)
    table = F.create_map(*[F.lit(v) for kv in _ONE_UPPER.items() for v in kv])
    parts = F.regexp_extract_all(x, F.lit(f"[{odd}]|[^{odd}]+"), F.lit(0))
    return F.when(x.rlike(f"[{odd}]"), F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(table, t), F.upper(t))), "")).otherwise(F.upper(x))


def script_language(x: Column) -> Column:
    """ja for kana, else ko for Hangul, else zh for Han, else en."""
    return (
        F.when(x.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(x.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(x.rlike(rf"[{HAN}]"), "zh").otherwise("en")
    )


def scored_by_character(language: Column) -> Column:
    """Languages whose error rate counts characters."""
    return F.lower(language).rlike(r"^(zh|cmn|yue)")


def metric_name(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """A metric's canonical name: an alias, else a slug; empty and n/a are `any`."""
    low = F.lower(F.trim(x))
    slug = F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    slug = F.when(x.isNull() | slug.isin("", "n_a", "none"), "any").otherwise(slug)
    if not aliases:
        return slug
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(table, low), slug)


def apply_rules(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, the longest first (ties in code-point order)."""
    for a, b in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def percent(x: Column, rate: Column) -> Column:
    """A score as shown: times 100 where it is a rate."""
    return F.when(rate, x * 100).otherwise(x)
