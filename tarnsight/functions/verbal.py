"""Written numbers in words, as recognisers' texts are compared: measures, dates, ordinals, money, telephone numbers, rule files.

A language is a list of rules, each a pattern and what becomes of a match; they run in order over the whole text, then every number that
is left is read as a cardinal. Numbers of more than `longest` signs stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from decimal import Decimal

from .spoken import HAN_DIGIT, words_en, words_zh

_LAST = dict(x.split("=") for x in "twelve=twelfth one=first nine=ninth two=second eight=eighth three=third five=fifth".split())


def cardinal(number: str, zh: bool) -> str:
    """A number in words; what follows a point is read digit by digit."""
    whole, _, part = number.partition(".")
    say = words_zh if zh else words_en
    out = [say(int(whole or "0"))]
    if part:
        out += ["点" if zh else "point", *(say(int(d)) for d in part)]
    return ("" if zh else " ").join(out)


def ordinal(n: int) -> str:
    """The English ordinal: twenty-first."""
    head, cut, last = re.fullmatch(r"(.*?)([ -]?)([a-z]+)", words_en(n)).groups()
    return head + cut + (_LAST.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def year(n: int) -> str:
    """An English year: nineteen ninety, two thousand and five."""
    century, rest = divmod(n, 100)
    if not 0 < century < 100 or century % 10 == 0 and rest < 10:
        return words_en(n)
    return f"{words_en(century)} {'hundred' if not rest else 'oh-' + words_en(rest) if rest < 10 else words_en(rest)}"


def dollars(amount: str) -> str:
    """An amount of dollars; cents are named where it has a point."""
    value = Decimal(amount.replace(",", ""))
    whole, cents = divmod(int(value * 100), 100)
    out = f"{words_en(whole)} dollar{'s' * (whole != 1)}"
    return out + (f", {words_en(cents)} cent{'s' * (cents != 1)}" if "." in amount else "")


def _digits(m: re.Match) -> str:
    return " ".join(words_en(int(c)) if c.isdigit() else c for c in m[0].replace("-", " "))


def _decade(m: re.Match) -> str:
    said = year(int(m[1]))
    return said[:-1] + "ies" if said.endswith("y") else said + "s"


def _pair(m: re.Match) -> str:
    n = 10 * HAN_DIGIT[m[0][0]] + HAN_DIGIT[m[0][1]]
    return words_zh(n) if n >= 10 else m[0]


Rule = tuple[str, "str | Callable[[re.Match], str]"]
_MEASURES = {"kg": "千克", "km": "千米", "cm": "厘米", "mm": "毫米", "ml": "毫升", "l": "升", "m": "米"}
_N = r"(\d+(?:[.]\d+)?)"
RULES: dict[str, list[Rule]] = {
    "zh": [
        (r"[零一二三四五六七八九]{2}", _pair),  # digits read one by one: 一五 is 十五
        (r"(?<!\d)\d{1,2}(?!\d)", lambda m: words_zh(int(m[0]))),
        (r"°\s*C", "摄氏度"),
        (_N + r"\s*m([23])(?![0-9A-Za-z])", lambda m: m[1] + {"2": "平方米", "3": "立方米"}[m[2]]),
        (r"(\d{4})\s*[/-]\s*(\d\d?)\s*[/-]\s*(\d\d?)", r"\1年\2月\3日"),
        (r"(?<!\d[-/])(?P<top>\d+)\s*/\s*(?P<low>\d+)(?![-/]\d)", lambda m: f"{m['low']}分之{m['top']}"),
        (_N + r"\s*%", r"百分之\1"),
        (r"(?<![A-Za-z0-9])\s*-\s*(\d+)", r"负\1"),
        (_N + rf"\s*({'|'.join(_MEASURES)})(?![A-Za-z])", lambda m: m[1] + _MEASURES[m[2]]),
    ],
    "en": [
        (r"(\d+)'", r"\1 feet"),
        (r"(?i)\b(\d+)(?:st|nd|rd|th)\b", lambda m: ordinal(int(m[1]))),
        (r"[$](?P<sum>\d\d?\d?(?:,\d\d\d)*(?:[.]\d\d?)?)", lambda m: dollars(m["sum"])),
        (r"\b(\d{4})s\b", _decade),
        (r"\b(?:\d{3}-)?\d{3}-\d{4}\b", _digits),
        (r"(?<!\w)-\s*" + _N, r"minus \1"),
    ],
}


def read_rules(lines: list[str], language: str) -> list[tuple[str, str]]:
    """(from, to) of a rule file's lines, the longest first: `a|b` or two words; # starts a comment. Blanks pad the result of spaced languages."""
    out = []
    for line in lines:
        line = " ".join(line.split()).partition("#")[0]
        parts = line.split("|" if line.count("|") == 1 else None)
        if not parts:
            continue
        if len(parts) != 2:
            raise ValueError(f"no rule: {line!r}")
        a, b = (x.strip() for x in parts)
        out.append((a, b if language.partition("_")[0] in ("ja", "ar", "zh") else f" {b} "))
    return sorted(out, key=lambda r: -len(r[0]))


def apply(text: str, rules: list[tuple[str, str]]) -> str:
    """Literal replacements in order; a rule with a word boundary at either end is a pattern."""
    for a, b in rules:
        text = re.sub(a, b, text) if a.startswith(r"\b") or a.endswith(r"\b") else text.replace(a, b)
    return text


def recogniser(text: str, language: str, rules: list[tuple[str, str]] = (), digits: list[tuple[str, str]] = (), longest: int = 12) -> str:
    """The text with all its numbers in words. digits: how single digits are read in runs of more than 4, or that begin with 0."""
    zh = language.startswith("zh")
    for pattern, to in RULES.get(language.partition("_")[0], ()):
        text = re.sub(pattern, to, text)
    text = apply(text, rules)

    def read(m: re.Match) -> str:
        n = m[0].rstrip(".")
        run = n[0] == "0" or n.isdigit() and 4 < len(n) < longest and int(n) != 10 ** (len(n) - 1)
        if digits and run:
            return n if len(n) > longest else apply(n, digits)
        n = n.replace(",", "")
        if len(n) > longest:
            return n
        if "." in n:
            n = str(float(n))
        said = cardinal(n, zh)
        return said if zh else f" {said} "

    return re.sub(r"\d+(?:,\d{3})*(?:\.\d*)?", read, apply(text, ()))


def code_switched(text: str) -> str:
    """Stretches with Latin letters as English, the others as Chinese."""
    return "".join(recogniser(p, "en" if re.search("[A-Za-z]", p) else "zh") for p in re.split(r"(?<=[一-鿿])(?=[^一-鿿])|(?<=[^一-鿿])(?=[一-鿿])", text))


# --- sets of characters


def code_points(spec: str) -> list[tuple[int, int]]:
    r"""The merged intervals of a set such as `a-z0一-鿿`."""
    one = r"\\u[0-9A-Fa-f]{4}|[^-]"
    value = lambda x: int(x[2:], 16) if len(x) == 6 else ord(x)
    found = sorted(sorted((value(a), value(b or a))) for a, b in re.findall(rf"({one})(?:-({one}))?", spec))
    out: list[tuple[int, int]] = []
    for lo, hi in found:
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def without(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The intervals of a less those of b."""
    for lo, hi in b:
        a = [x for p, q in a for x in ((p, min(q, lo - 1)), (max(p, hi + 1), q)) if x[0] <= x[1]]
    return sorted(set(a))


def char_class(intervals: list[tuple[int, int]], plain: bool = False) -> str:
    """A set as text again; plain: printable ASCII as itself."""
    show = lambda c: chr(c) if plain and 32 <= c < 127 else f"\\u{c:04x}"
    return "".join(show(lo) if lo == hi else f"{show(lo)}-{show(hi)}" for lo, hi in intervals)


# --- cleaning

_DASHES = re.compile("[‐-―−－-]+")
_QUOTES = re.compile("[‘’‛ʼ`´']+")
_NO_WIDTH = dict.fromkeys(map(ord, "​‌‍﻿᠋᠌᠎⁠"))


def ascii_digits(s: str) -> str:
    """Decimal digits of any script as ASCII ones."""
    return "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else c for c in s)


def connecting(s: str, signs: re.Pattern, plain: str, keep: bool = True) -> str:
    """Runs of some signs as one plain sign between letters or digits, as a blank elsewhere; all as blanks unless kept."""
    inside = lambda m: m.start() > 0 and m.end() < len(s) and s[m.start() - 1].isalnum() and s[m.end()].isalnum()
    return signs.sub(lambda m: plain if keep and inside(m) else " ", s)


def clean(s: str, language: str = "en", alphabet: str | None = None, fold: bool = False, numbers: bool = True, lower: bool = True, dashes: bool = True, quotes: bool = True) -> str:
    """A text of any language for comparison: compatibility forms, ASCII digits, numbers in words, brackets out, only connecting dashes and quotes.

    alphabet: a set of characters (as for `code_points`); all others become blanks. fold: letters lose their diacritics.
    """
    s = s.translate(_NO_WIDTH)
    s = "".join(c if c in "\n\t" or unicodedata.category(c)[0] not in "CZ" else " " for c in s)
    s = ascii_digits(unicodedata.normalize("NFKC", s))
    if fold:
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
    if numbers:
        s = recogniser(s, language)
    s = re.sub(r"[(\[{<][^)\]}>]*[)\]}>]", " ", s)
    s = connecting(connecting(s, _DASHES, "-", dashes), _QUOTES, "'", quotes)
    if alphabet is not None:
        known = code_points(alphabet)
        s = "".join(c if c.isspace() or any(lo <= ord(c) <= hi for lo, hi in known) else " " for c in s)
    return " ".join((s.lower() if lower else s).split())
