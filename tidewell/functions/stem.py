"""Stemmers of 14 languages after the published Snowball descriptions: English (with the changes of version 3),
German, Dutch, Swedish, Norwegian, Danish, Russian, Finnish, Spanish, French, Italian and Portuguese by their
steps; Romanian and Catalan by their suffix rules. Words of other languages are left as they are. All but the last
two are held against published pairs.

``stem_column`` is an Arrow function; give it distinct words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .stem_romance import french, italian, portuguese, spanish

_V = "aeiouy"


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first non-vowel after a vowel, and the same again."""
    m = re.compile(f"[{vowels}][^{vowels}]")
    a = m.search(word)
    r1 = a.end() if a else len(word)
    b = m.search(word, r1)
    return r1, b.end() if b else len(word)


# English. Special words, words left alone, beginnings that set R1, and suffixes by step.
_EN_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_EN_SAME_1A = frozenset("inning outing canning herring earring evening proceed exceed succeed".split())
_EN_R1 = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
_EN_2 = dict(x.split(":") for x in (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous "
    "iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogist:og ogi:og li:"
).split())
_EN_3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _ends(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word)) or word == "past"


def _english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    if word in _EN_SAME:
        return word
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.lstrip("'"))
    start = _ends_with_start(w)
    if start:
        r1 = start
        r2 = _regions(w[r1:], _V)[0] + r1
    else:
        r1, r2 = _regions(w, _V)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_SAME_1A:
        return w
    # 1b
    s = _ends(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s:
        base = w[: -len(s)]
        if s == "ing" and re.fullmatch(r"[^aeiouyY][yY]", base):
            w = base[0] + "ie"
        elif re.search(r"[aeiouy]", base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
                w = base if re.fullmatch(r"[aeo]..", base) else base[:-1]
            elif len(base) <= r1 and _short(base):
                w = base + "e"
            else:
                w = base
    # 1c
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    # 2
    s = _ends(w, _EN_2)
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif s == "li":
            w = base if base[-1:] in set("cdeghkmnrt") else w
        else:
            w = base + _EN_2[s]
    # 3
    s = _ends(w, _EN_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _EN_3[s]
    # 4
    s = _ends(w, _EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _ends_with_start(word: str) -> int:
    return next((len(p) for p in _EN_R1 if word.startswith(p)), 0)


def _german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, 3)
    s = _ends(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in set("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _ends(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or (w[-3:-2] in set("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(s)]
    s = _ends(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        base = w[: -len(s)]
        if s in ("end", "ung"):
            w = base[:-2] if base.endswith("ig") and not base.endswith("eig") and len(base) - 2 >= r2 else base
        elif s in ("ig", "ik", "isch"):
            w = w if base.endswith("e") else base
        elif s in ("lich", "heit"):
            w = base[:-2] if base.endswith(("er", "en")) and len(base) - 2 >= r1 else base
        else:
            t = _ends(base, ("lich", "ig"))
            w = base[: -len(t)] if t and len(base) - len(t) >= r2 else base
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _scandinavian(suffixes: str, s_after: str, pairs: str, last: str, vowels: str, undouble: bool = False):
    main, doubles, tail = suffixes.split(), tuple(pairs.split()), last.split()

    def stem(word: str) -> str:
        r1 = max(_regions(word, vowels)[0], 3)
        w = word
        s = _ends(w[r1:], [*main, "s"])
        if s and (s != "s" or w[-2:-1] in set(s_after)):
            w = w[: -len(s)]
        if len(w) > r1 and w[r1:].endswith(doubles):
            w = w[:-1]
        s = _ends(w[r1:], tail)
        w = w[: -len(s)] if s else w
        return w[:-1] if undouble and len(w) > r1 and w[-1:] == w[-2:-1] and w[-1] not in vowels else w

    return stem


# Suffixes of the Scandinavian descriptions (their letters with marks, and folded).
_SWEDISH = _scandinavian(
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast",
    "bcdfghjklmnoprtvy", "dd gd nn dt gt kt tt", "lig ig els", "aeiouyäåö",
)
_NORWEGIAN = _scandinavian(
    "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", "bcdfghjlmnoprtvyz", "dt vt", "leg eleg ig eig lig elig els lov elov slov hetslov", "aeiouyæåø"
)
_DANISH = _scandinavian(
    "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret",
    "abcdfghjklmnoprtvyzå", "gd dt gt kt", "ig lig elig els", "aeiouyæåø", undouble=True,
)


def _rv(word: str, vowels: str) -> int:
    """Start of RV of the Romance descriptions."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        m = re.compile(f"[{vowels}]").search(word, 2)
    elif word[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(word, 2)
    else:
        return 3
    return m.end() if m else len(word)


def _romance(vowels: str, standard: str, verbs: str, residual: str):
    derived, endings, rest = standard.split(), verbs.split(), residual.split()

    def stem(word: str) -> str:
        rv, r2 = _rv(word, vowels), _regions(word, vowels)[1]
        s = _ends(word, derived)
        if s and len(word) - len(s) >= r2:
            w = word[: -len(s)]
        else:
            s = _ends(word[rv:], endings)
            w = word[: -len(s)] if s else word
        s = _ends(w[rv:], rest)
        return w[: -len(s)] if s else w

    return stem


# Derivational suffixes, verb endings and last vowels, with and without marks.
_ROMANIAN = _romance(
    "aeiouăâî",
    "abila abile abili abilă ibila ibile ibili ibilă atoare atori ator atoarea atorul itate itati ități itatea icala icale icali icală iciva icive icivi ant anta ante anti antă ist ista iste isti istă iști "
    "ism isme ic ica ice ici ică os oasa oase osi oși oasă iv iva ive ivi ivă area ari iune iuni țiune țiuni ment mente ut uta ute uti ută",
    "are ere ire ez ezi eaza ează eam eai ea eau am ai au esc ește este ești ind and ând ase aseși aserăm usem use useși ise isem iseși it ita ite iti ită at ata ate ati ată ăm em im îm ați eți iți iră ară ură",
    "ul ului urilor uri ilor iilor ile ii ei ea ie lor le a e i ă u",
)
_CATALAN = _romance(
    "aeiouàèéíïòóúü",
    "ament ments ment acions ació acio ancia ància encia ència ible ibles able ables isme ismes ista istes itat itats osa oses os osos iva ives iu ius ador adora adors adores logia logies eria eries ament",
    "arien aria aries arem areu aran aré are eria eries erem ereu eran eré iria iries irem ireu iran iré ava aves aven avem aveu ant ent int at ada ats ades it ida its ides ut uda uts udes ar er ir re en es em eu im iu o",
    "s a e o i à é í ó",
)


def _dutch(word: str) -> str:
    v = "aeiouyè"
    w = re.sub(rf"(?:^y|(?<=[{v}])y)", "Y", word)
    w = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, 3)
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x
    s = _ends(w, ("heden", "ene", "en", "se", "s"))
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "heden":
            w = base + "heid"
        elif s in ("ene", "en"):
            w = undouble(base) if base and base[-1] not in v and not base.endswith("gem") else w
        elif base and base[-1] not in v + "j":
            w = base
    dropped_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in v:
        w, dropped_e = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en") and len(w) - 2 >= r1 and w[-3:-2] not in v and not w.endswith("gemen"):
            w = undouble(w[:-2])
    s = _ends(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        base = w[: -len(s)]
        if s in ("end", "ing"):
            w = base[:-2] if base.endswith("ig") and len(base) - 2 >= r2 and base[-3:-2] != "e" else undouble(base)
        elif s == "ig":
            w = base if base[-1:] != "e" else w
        elif s == "lijk":
            w = undouble(base[:-1]) if base.endswith("e") and len(base) - 1 >= r1 else base
        elif s == "baar" or dropped_e:
            w = base
    m = re.search(rf"([^{v}I])(aa|ee|oo|uu)([^{v}I])$", w)
    if m:
        w = w[:-2] + w[-1]
    return w.lower()


# Suffixes of the Russian description, those of a first group only after а or я; a folded й counts as и.
_RU = {
    "gerund": ("в вши вшись", "ив ивши ившись ыв ывши ывшись"),
    "adjective": ("", "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"),
    "participle": ("ем нн вш ющ щ", "ивш ывш ующ"),
    "verb": (
        "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
        "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
    ),
    "noun": ("", "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"),
}
_RU_SUFFIXES = {k: {x: first for first, group in ((True, groups[0]), (False, groups[1])) for s in group.split() for x in (s, s.replace("й", "и"))} for k, groups in _RU.items()}


def _ru_cut(w: str, kind: str) -> str | None:
    """``w`` without its longest suffix of a kind; None if it has none, or not the letter that goes before it."""
    s = _ends(w, _RU_SUFFIXES[kind])
    if not s or (_RU_SUFFIXES[kind][s] and not w[: -len(s)].endswith(("а", "я"))):
        return None
    return w[: -len(s)]


def _russian(word: str) -> str:
    v = "аеиоуыэюя"
    word = word.replace("ё", "е")
    m = re.search(f"[{v}]", word)
    if not m:
        return word
    head, w = word[: m.end()], word[m.end() :]
    r2 = max(0, _regions(word, v)[1] - len(head))
    cut = _ru_cut(w, "gerund")
    if cut is None:
        w = re.sub("(ся|сь)$", "", w)
        cut = _ru_cut(w, "adjective")
        if cut is not None:
            without = _ru_cut(cut, "participle")
            cut = cut if without is None else without
        else:
            cut = _ru_cut(w, "verb")
            cut = _ru_cut(w, "noun") if cut is None else cut
    w = w if cut is None else cut
    w = w[:-1] if w.endswith("и") else w
    s = _ends(w, ("ост", "ость"))
    w = w[: -len(s)] if s and len(w) - len(s) >= r2 else w
    w = re.sub("(ейше|ейш|еише|еиш)$", "", w)
    w = w[:-1] if w.endswith("нн") or w.endswith("ь") else w
    return head + w


# Endings of the Finnish description.
_FI_PARTICLES = "kin kaan kään ko kö han hän pa pä".split()
_FI_OWN = {"an": "ta ssa sta lla lta na", "än": "tä ssä stä llä ltä nä", "en": "lle ine"}
_FI_CASES = "ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine".split()
_FI_ILLATIVE = {"han": "a", "hen": "e", "hin": "i", "hon": "o", "hän": "ä", "hön": "ö"}
_FI_COMPARATIVE = "mpi mpa mpä mmi mma mmä".split()
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")


def _finnish(word: str) -> str:
    v = "aeiouyäö"
    r1, r2 = _regions(word, v)
    w = word
    inside = lambda suffixes, start: _ends(w[start:], suffixes)
    # particles
    s = inside([*_FI_PARTICLES, "sti"], r1)
    if s and (len(w) - len(s) >= r2 if s == "sti" else w[: -len(s)].endswith(tuple(v + "nt"))):
        w = w[: -len(s)]
    # possessives
    s = inside("si ni nsa nsä mme nne an än en".split(), r1)
    base = w[: -len(s)] if s else w
    if s == "ni":
        w = base[:-3] + "ksi" if base.endswith("kse") else base
    elif s in _FI_OWN:
        w = base if base[r1:].endswith(tuple(_FI_OWN[s].split())) else w
    elif s != "si" or not base.endswith("k"):
        w = base
    # cases
    s = inside([*_FI_CASES, *_FI_ILLATIVE, "siin", "den", "tten", "seen", "n", "a", "ä", "tta", "ttä"], r1)
    base = w[: -len(s)] if s else w
    if s in _FI_ILLATIVE:
        found = base.endswith(_FI_ILLATIVE[s])
    elif s in ("siin", "den", "tten"):
        found = bool(re.search(f"[{v}]i$", base))
    elif s == "seen":
        found = base.endswith(_FI_LONG)
    elif s in ("a", "ä"):
        found = bool(re.search(f"[^{v}][{v}]$", base))
    elif s in ("tta", "ttä"):
        found = base.endswith("e")
    else:
        found = bool(s)
    if found:
        w = base[:-1] if s == "n" and base.endswith((*_FI_LONG, "ie")) else base
    # comparatives
    s = inside([*_FI_COMPARATIVE, *("i" + x for x in _FI_COMPARATIVE), "eja", "ejä"], r2)
    if s and (s not in _FI_COMPARATIVE or not w[: -len(s)].endswith("po")):
        w = w[: -len(s)]
    # plurals
    if found:
        w = w[:-1] if w[r1:].endswith(("i", "j")) else w
    elif len(w) > r1 and re.search(f"[{v}]t$", w):
        w = w[:-1]
        s = inside(("mma", "imma"), r2)
        if s == "imma" or (s and not w[: -len(s)].endswith("po")):
            w = w[: -len(s)]
    # what is left at the end
    if w[r1:].endswith(_FI_LONG):
        w = w[:-1]
    if re.search(f"[^{v}][aäei]$", w[r1:]):
        w = w[:-1]
    if w[r1:].endswith(("oj", "uj", "jo")):
        w = w[:-1]
    return re.sub(rf"([^{v}])\1([{v}]*)$", r"\1\2", w)


STEMMERS = {
    "en": _english, "de": _german, "nl": _dutch, "es": spanish, "fr": french, "it": italian, "pt": portuguese, "ro": _ROMANIAN, "ca": _CATALAN, "sv": _SWEDISH, "no": _NORWEGIAN, "nb": _NORWEGIAN,
    "da": _DANISH, "fi": _finnish, "ru": _russian,
}


def supported_languages() -> list[str]:
    return sorted(STEMMERS)


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    """The stem; words of unknown languages stay as they are. The region of a language tag doesn't count."""
    of = STEMMERS.get((language or "").lower().split("-")[0])
    return of(word) if of and word else word


@pandas_udf(StringType())
def _stem(word: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else stem(w, lang or "") for w, lang in zip(word, language)], dtype=object)


def stem_column(word: Column, language: Column) -> Column:
    return _stem(word, language)
