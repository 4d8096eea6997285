"""English as it is scored: contractions and titles spelled, numbers as digits, signs out.

Words are looked up, not matched by a list of patterns: a word is its stem and its endings, a number is a state that each number word
changes. Everything works on one text; `spoken.chain` makes Arrow UDFs of it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

FILLERS = frozenset("hmm mm mhm mmm uh um".split())
_SPELLED = dict(
    x.split("=")
    for x in (
        "won't=will not|can't=can not|let's=let us|ain't=aint|y'all=you all|ma'am=madam|i'ma=i am going to|imma=i am going to|gonna=going to|wanna=want to|gotta=got to|"
        "woulda=would have|coulda=could have|shoulda=should have|mr=mister|mrs=missus|dr=doctor|prof=professor|st=saint|jr=junior|sr=senior|esq=esquire|hon=honorable|"
        "capt=captain|lt=lieutenant|col=colonel|gen=general|gov=governor|sen=senator|rep=representative|pres=president|rev=reverend|ald=alderman|asst=assistant|assoc=associate"
    ).split("|")
)
_ENDINGS = {"n't": "not", "'re": "are", "'s": "is", "'d": "would", "'ll": "will", "'t": "not", "'ve": "have", "'m": "am"}
#: What 's and 'd stand for before some participles.
_BEFORE = {("'s", w): "has" for w in ("been", "gone", "got")} | {("'d", w): "had" for w in ("been", "gone", "done")}
_LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "Œ": "OE", "Æ": "AE", "Ø": "O", "ẞ": "SS", "Đ": "D", "Ð": "D", "Þ": "Th", "Ł": "L"})


def without_signs(s: str, keep: str = "", fold: bool = True) -> str:
    """Marks, symbols and punctuation to blanks; with fold, letters without their diacritics."""
    out = []
    for c in unicodedata.normalize("NFKD" if fold else "NFKC", s):
        kind = unicodedata.category(c)
        out.append(c if c in keep else "" if fold and kind == "Mn" else " " if kind[0] in "MSP" else c)
    return "".join(out).translate(_LETTERS) if fold else "".join(out)


def basic(s: str, fold: bool = False, letters: bool = False) -> str:
    """Any language: lower case, bracketed parts and signs out; with fold no diacritics, with letters a blank between graphemes."""
    import regex

    s = without_signs(_ASIDE.sub("", s.lower()), fold=fold).lower()
    units = (m[0] for m in regex.finditer(r"\X", s)) if letters else s.split()
    return " ".join(u for u in units if u.strip())


def _spell_out(s: str) -> str:
    def word(m: re.Match) -> str:
        stem, ends = m[0], []
        following = re.match(r"\s+([a-z]+)", s[m.end() :])
        inside = m.start() and (s[m.start() - 1].isalnum() or s[m.start() - 1] == "_")  # the end of 1st is no saint
        while stem not in _SPELLED or inside:
            end = next((e for e in _ENDINGS if stem.endswith(e)), None)
            if end is None:
                break
            stem = stem[: -len(end)]
            ends.append(_BEFORE.get((end, following[1] if following and not ends else ""), _ENDINGS[end]))
        if not inside:
            stem = "" if stem in FILLERS else _SPELLED.get(stem, stem)
        return " ".join([stem, *ends[::-1]])

    return re.sub(r"[a-z](?:[a-z']*[a-z])?|'(?:[a-z]+)", word, s)


def _number_words() -> dict[str, tuple[str, int, str]]:
    """Each number word's kind, value and ending."""
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    odd = {0: "zeroth", 1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth"}
    out = {"o": ("digit", 0, ""), "oh": ("digit", 0, "")}
    for n, w in enumerate(small):
        kind = "digit" if n < 10 else "teen"
        out[w] = (kind, n, "")
        if n:
            out["sixes" if n == 6 else w + "s"] = (kind, n, "s")
        out[odd.get(n, w + "th")] = (kind, n, {1: "st", 2: "nd", 3: "rd"}.get(n, "th"))
    for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2):
        out |= {w: ("ten", 10 * n, ""), w[:-1] + "ies": ("ten", 10 * n, "s"), w[:-1] + "ieth": ("ten", 10 * n, "th")}
    powers = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
    for w, n in [("hundred", 100)] + [(w, 1000**k) for k, w in enumerate(powers, 1)]:
        out |= {w: ("scale", n, ""), w + "s": ("scale", n, "s"), w + "th": ("scale", n, "th")}
    return out


WORDS = _number_words()
_SIGN = {w: c for c, names in (("-", "minus negative"), ("+", "plus positive")) for w in names.split()}
_MONEY = {name + end: c for c, name in zip("$€£¢", ("dollar", "euro", "pound", "cent")) for end in ("", "s")}
_ASIDE = re.compile(r"[\[<][^\]>]*[\]>]|\([^)]+\)")  # what stands in brackets
_TIMES = {"double": 2, "triple": 3}
_FIGURE = re.compile(r"([-+$€£¢]?)(\d+(?:[.]\d+)?)")


class _Reader:
    """The number that is being read: an int while its words compose one, else the text of its digits."""

    def __init__(self):
        self.out: list[str] = []
        self.value: int | str | None = None
        self.sign, self.before = "", ""  # before: the kind of the last number word

    def say(self, text: str) -> None:
        self.out.append(self.sign + text)
        self.sign, self.value, self.before = "", None, ""

    def close(self, ending: str = "") -> None:
        if self.value is not None:
            self.say(f"{self.value}{ending}")

    def figure(self, sign: str, digits: str) -> None:
        if isinstance(self.value, str) and self.value.endswith("."):
            self.value += sign + digits
            return
        self.close()
        self.sign = sign or self.sign
        self.value = digits if "." in digits and not Fraction(digits).denominator == 1 else int(Fraction(digits))

    def add(self, kind: str, n: int) -> None:
        v, room = self.value, 10 if kind == "digit" else 100
        if kind == "digit" and n == 0:
            self.value = f"{v or ''}0"
        elif kind == "scale":
            self.scale(n)
        elif v is None:
            self.value = n
        elif isinstance(v, str) and self.before == "ten" and kind == "digit":
            self.value = v[:-1] + str(n)
        elif isinstance(v, int) and v % room == 0 and not (kind != "ten" and self.before in ("digit", "teen")):
            self.value = v + n
        else:
            self.value = f"{v}{n}"
        self.before = kind

    def scale(self, n: int) -> None:
        v = self.value
        if v is None:
            self.value = n
        elif isinstance(v, int) and v:
            self.value = v // 1000 * 1000 + v % 1000 * n
        else:
            whole = Fraction(str(v)) * n if re.fullmatch(r"\d+(\.\d+)?", str(v)) else Fraction(1, 2)
            if whole.denominator == 1 and v:
                self.value = whole.numerator
            else:
                self.close()
                self.value = n


def numbers(s: str) -> str:
    """Spelled numbers as digits: cardinals, years, decimals, ordinals, plurals, signs, percent, currency with cents, double and triple, halves."""
    s = re.sub(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ", s)
    s = re.sub(r"(?<=\d) +(?=(?:th|s|rd|nd|st)\b)", "", s)
    words = s.split()
    halves = [i for i in range(1, len(words) - 2) if words[i : i + 3] == ["and", "a", "half"] and (words[i - 1] in WORDS and not WORDS[words[i - 1]][2])]
    for i in reversed(halves):
        words[i : i + 3] = ["point", "five"]
    r, i = _Reader(), 0
    numeric = lambda w: w is not None and (w in WORDS or bool(re.fullmatch(r"\d+(\.\d+)?", w)))
    while i < len(words):
        w, after = words[i], words[i + 1] if i + 1 < len(words) else None
        m = _FIGURE.fullmatch(w)
        i += 1
        if m:
            r.figure(*m.groups())
            r.before = ""
        elif w in WORDS and not (w in ("o", "oh") and r.value is None and not numeric(after)):
            kind, n, ending = WORDS[w]
            r.add(kind, n)
            if ending:
                r.close(ending)
        elif w in _SIGN and (numeric(after) or after in _TIMES):
            r.close()
            r.sign = _SIGN[w]
        elif w in _MONEY and r.value is not None:
            r.sign = _MONEY[w]
            r.close()
        elif r.value is not None and w == "percent":
            r.close("%")
        elif r.value is not None and w == "per" and after == "cent":
            r.close("%")
            i += 1
        elif w in _TIMES and after in WORDS and WORDS[after][0] == "digit" and not WORDS[after][2]:
            r.value = f"{'' if r.value is None else r.value}{str(WORDS[after][1]) * _TIMES[w]}"
            r.before = "digit"
            i += 1
        elif w == "point" and numeric(after):
            r.value = f"{'' if r.value is None else r.value}."
            r.before = ""
        elif w == "and" and r.before == "scale" and numeric(after):
            r.before = ""
        else:
            r.close()
            r.say(w)
    r.close()
    s = " ".join(r.out)
    # money and its cents are one amount; one of no whole unit is cents alone; a lone one stays a word
    s = re.sub(r"(?<=[$€£])(?P<whole>\d+)(?: and)? ¢(?P<part>\d\d?)\b", lambda m: f"{m['whole']}.{int(m['part']):02d}", s)
    s = re.sub(r"[$€£]0[.](?P<part>\d\d?)\b", lambda m: f"¢{int(m['part'])}", s)
    return re.sub(r"\b1(?=s?\b)", "one", s)


@lru_cache(1)
def american() -> dict[str, str]:
    """British spellings of common families of words and their American ones; `read_spelling` takes a longer list."""
    out = {}
    for stem in "arm behavi cand clam col enam end fav flav glam harb hon hum lab neighb od parl ranc rig rum sav splend tum val vap vig".split():
        for end in ("", "s", "ed", "ing", "able", "ably", "ful", "less", "ite", "ites", "er", "ers", "hood", "hoods", "al"):
            out[stem + "our" + end] = stem + "or" + end
    for stem in "calib cent fib goit lit lust meag met och sab scept somb spect theat".split():
        for end in ("e", "es", "ed"):
            out[f"{stem}r{end}"] = f"{stem}er" + end.replace("e", "", 1).replace("d", "ed")
    for stem in "apolog author capital categor character civil colon critic emphas energ equal fertil final general harmon hospital idol immun legal local material maxim memor minim mobil modern monopol normal optim organ penal popular priorit public real recogn revolution special stabil standard steril summar symbol sympath util visual".split():
        for end in ("e", "es", "ed", "er", "ers", "ing", "ation", "ations"):
            out[f"{stem}is{end}"] = f"{stem}iz{end}"
    for stem in "anal paral catal".split():
        for end in ("e", "es", "ed", "ing"):
            out[f"{stem}ys{end}"] = f"{stem}yz{end}"
    for stem in "cancel channel counsel dial fuel fulfil label level marvel model panel pedal quarrel signal total travel tunnel".split():
        stem = stem.removesuffix("l")
        for end in ("ed", "er", "ers", "ing"):
            out[f"{stem}ll{end}"] = f"{stem}l{end}"
    pairs = "grey=gray|greys=grays|defence=defense|offence=offense|licence=license|pretence=pretense|practise=practice|practised=practiced|practising=practicing|catalogue=catalog|catalogues=catalogs|dialogue=dialog|dialogues=dialogs|programme=program|programmes=programs|cheque=check|cheques=checks|jewellery=jewelry|aluminium=aluminum|aeroplane=airplane|aeroplanes=airplanes|mum=mom|pyjamas=pajamas|tyre=tire|tyres=tires|plough=plow|sceptical=skeptical|mould=mold|moustache=mustache|kerb=curb|storey=story|cosy=cozy|ageing=aging|judgement=judgment|enrol=enroll|fulfil=fulfill|skilful=skillful|wilful=willful"
    return out | dict(p.split("=") for p in pairs.split("|"))


def read_spelling(path: str) -> dict[str, str]:
    """A spelling map from a JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def english(s: str, spelling: dict[str, str] | None = None) -> str:
    """English as scored; spelling: words to be replaced (American for British ones where none is given)."""
    known = american() if spelling is None else spelling
    s = _ASIDE.sub("", s.lower())
    s = _spell_out(re.sub(r"\s+(?=')", "", s))
    s = re.sub(r"(?<=\d),(?=\d)", "", s)
    s = without_signs(re.sub(r"\.(?!\d)", " ", s), keep=".%$¢€£")
    words = [known.get(w, w) for w in numbers(s).split()]
    # what is left of number signs counts only beside digits
    s = re.sub(r"[$€£¢.](?!\d)", " ", " ".join(words))
    return " ".join(re.sub(r"(?<!\d)%", " ", s).split())
