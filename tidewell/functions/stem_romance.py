"""Spanish, Italian, Portuguese and French stemmers by the steps of the published Snowball descriptions.

A word's regions are found once; they are places from its start, so they stay true while suffixes go. A step
takes the longest of its suffixes. Endings, letters and replacements are the descriptions' own.
"""

from __future__ import annotations

import re


class Word:
    """A word in the course of its steps, with the starts of RV, R1 and R2."""

    def __init__(self, text: str, vowels: str, rv: int):
        self.text, self.vowels, self.rv = text, vowels, rv
        gap = re.compile(f"[{vowels}][^{vowels}]")
        a = gap.search(text)
        self.r1 = a.end() if a else len(text)
        b = gap.search(text, self.r1)
        self.r2 = b.end() if b else len(text)

    def longest(self, suffixes, start: int = 0) -> str | None:
        """The longest suffix that stands behind ``start``."""
        return max((s for s in suffixes if self.text.endswith(s) and len(self.text) - len(s) >= start), key=len, default=None)

    def cut(self, suffix: str, start: int, put: str = "") -> bool:
        """``put`` for a suffix that the word ends in, if it stands behind ``start``."""
        if not self.text.endswith(suffix) or len(self.text) - len(suffix) < start:
            return False
        self.text = self.text[: len(self.text) - len(suffix)] + put
        return True

    def cut_one(self, suffixes: str, start: int) -> bool:
        """The longest of some suffixes, if it stands behind ``start``."""
        found = self.longest(suffixes.split())
        return bool(found) and self.cut(found, start)


def _region_v(word: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        m = re.compile(f"[{vowels}]").search(word, 2)
    elif word[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(word, 2)
    else:
        return 3
    return m.end() if m else len(word)


def _table(*rows: tuple[str, str]) -> dict[str, str]:
    """Suffix to the name of what is done with it."""
    return {suffix: action for action, suffixes in rows for suffix in suffixes.split()}


def _adverb(w: Word, stems: str) -> None:
    """What is left before -amente: -(at)iv-, or one of ``stems``."""
    if w.cut("iv", w.r2):
        w.cut("at", w.r2)
    else:
        w.cut_one(stems, w.r2)


# The suffixes of each description, by step and by what is done with them.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_BEFORE = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir", "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir", "yendo": "yendo"}
_ES_1 = _table(
    ("plain", "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    ("ic", "adora ador ación acion adoras adores aciones ante antes ancia ancias"), ("log", "logía logías"), ("u", "ución ucion uciones"), ("ente", "encia encias"),
    ("amente", "amente"), ("mente", "mente"), ("idad", "idad idades"), ("iv", "iva ivo ivas ivos"),
)
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_GU = "en es éis emos".split()
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = Word(word, vowels, _region_v(word, vowels))
    pronoun = w.longest(_ES_PRONOUNS)
    if pronoun:
        base = Word(word[: -len(pronoun)], vowels, w.rv)
        before = base.longest(_ES_BEFORE, w.rv)
        if before and (before != "yendo" or base.text.endswith("uyendo")):
            w.text = base.text[: len(base.text) - len(before)] + _ES_BEFORE[before]
    if not _spanish_1(w) and not _spanish_y(w):
        s = w.longest(_ES_GU + _ES_VERB, w.rv)
        if s:
            w.cut(s, 0)
            if s in _ES_GU and w.text.endswith("gu"):
                w.text = w.text[:-1]
    s = w.longest("os a o á í ó e é".split(), w.rv)
    if s:
        w.cut(s, 0)
        if s in "eé" and w.text.endswith("gu"):
            w.cut("u", w.rv)
    return w.text.translate(str.maketrans("áéíóú", "aeiou"))


def _spanish_1(w: Word) -> bool:
    s = w.longest(_ES_1)
    action = _ES_1.get(s or "")
    if not action or not w.cut(s, w.r1 if action == "amente" else w.r2, action if action in ("log", "u", "ente") else ""):
        return False
    if action == "ic":
        w.cut("ic", w.r2)
    elif action == "amente":
        _adverb(w, "os ic ad")
    elif action == "mente":
        w.cut_one("ante able ible", w.r2)
    elif action == "idad":
        w.cut_one("abil ic iv", w.r2)
    elif action == "iv":
        w.cut("at", w.r2)
    return True


def _spanish_y(w: Word) -> bool:
    s = w.longest(_ES_Y, w.rv)
    return bool(s) and w.text[: len(w.text) - len(s)].endswith("u") and w.cut(s, 0)


_IT_PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
).split()
_IT_1 = _table(
    ("plain", "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"),
    ("ic", "azione azioni atore atori"), ("log", "logia logie"), ("u", "uzione uzioni usione usioni"), ("ente", "enza enze"), ("rv", "amento amenti imento imenti"),
    ("amente", "amente"), ("ita", "ità"), ("iv", "ivo ivi iva ive"),
)
_IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti "
    "ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(word: str) -> str:
    vowels = "aeiouàèìòù"
    word = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    word = re.sub(f"(?<=[{vowels}])[iu](?=[{vowels}])", lambda m: m[0].upper(), word)
    w = Word(word, vowels, _region_v(word, vowels))
    pronoun = w.longest(_IT_PRONOUNS)
    if pronoun:
        base = Word(word[: -len(pronoun)], vowels, w.rv)
        before = base.longest(("ando", "endo", "ar", "er", "ir"), w.rv)
        if before:
            w.text = base.text + ("e" if before[-1] == "r" else "")
    if not _italian_1(w):
        s = w.longest(_IT_VERB, w.rv)
        if s:
            w.cut(s, 0)
    s = w.longest("aeioàèìò", w.rv)
    if s:
        w.cut(s, 0)
        w.cut("i", w.rv)
    for double in ("ch", "gh"):
        w.cut(double, w.rv, double[0])
    return w.text.lower()


def _italian_1(w: Word) -> bool:
    s = w.longest(_IT_1)
    action = _IT_1.get(s or "")
    start = {"amente": w.r1, "rv": w.rv}.get(action or "", w.r2)
    if not action or not w.cut(s, start, action if action in ("log", "u", "ente") else ""):
        return False
    if action == "ic":
        w.cut("ic", w.r2)
    elif action == "amente":
        _adverb(w, "os ic abil")
    elif action == "ita":
        w.cut_one("abil ic iv", w.r2)
    elif action == "iv" and w.cut("at", w.r2):
        w.cut("ic", w.r2)
    return True


_PT_1 = _table(
    ("plain", "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"),
    ("log", "logia logias"), ("u", "uça~o uço~es"), ("ente", "ência ências"), ("amente", "amente"), ("mente", "mente"), ("idad", "idade idades"), ("iv", "iva ivo ivas ivos"), ("ir", "ira iras"),
)
_PT_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo "
    "ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis "
    "áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos "
    "armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêô"
    word = word.replace("ã", "a~").replace("õ", "o~")
    w = Word(word, vowels, _region_v(word, vowels))
    changed = _portuguese_1(w)
    if not changed:
        s = w.longest(_PT_VERB, w.rv)
        changed = bool(s) and w.cut(s, 0)
    if changed:
        if w.text.endswith("ci"):
            w.cut("i", w.rv)
    else:
        s = w.longest("os a i o á í ó".split(), w.rv)
        if s:
            w.cut(s, 0)
    s = w.longest("eéê", w.rv)
    if s:
        w.cut(s, 0)
        if w.text.endswith(("gu", "ci")):
            w.cut(w.text[-1], w.rv)
    elif w.text.endswith("ç"):
        w.text = w.text[:-1] + "c"
    return w.text.replace("a~", "ã").replace("o~", "õ")


def _portuguese_1(w: Word) -> bool:
    s = w.longest(_PT_1)
    action = _PT_1.get(s or "")
    if action == "ir":
        return w.text[: len(w.text) - len(s)].endswith("e") and w.cut(s, w.rv, "ir")
    if not action or not w.cut(s, w.r1 if action == "amente" else w.r2, action if action in ("log", "u", "ente") else ""):
        return False
    if action == "amente":
        _adverb(w, "os ic ad")
    elif action == "mente":
        w.cut_one("ante avel ível", w.r2)
    elif action == "idad":
        w.cut_one("abil ic iv", w.r2)
    elif action == "iv":
        w.cut("at", w.r2)
    return True


_FR_1 = _table(
    ("plain", "ance iqUe isme able iste eux ances iqUes ismes ables istes"), ("ic", "atrice ateur ation atrices ateurs ations"), ("log", "logie logies"), ("u", "usion ution usions utions"), ("ent", "ence ences"),
    ("ement", "ement ements"), ("ite", "ité ités"), ("if", "if ive ifs ives"), ("eaux", "eaux"), ("aux", "aux"), ("euse", "euse euses"), ("issement", "issement issements"), ("amment", "amment"), ("emment", "emment"),
    ("ment", "ment ments"),
)
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    word = re.sub(r"^(?:[cdjlmnst]|qu)'(?=.)", "", word)
    v = f"[{vowels}]"
    word = re.sub("qu", "qU", word)
    word = re.sub(f"(?<={v})[ui](?={v})", lambda m: m[0].upper(), word)
    word = re.sub(f"(?<={v})y|y(?={v})", "Y", word)
    if re.match(f"{v}{v}|par|col|tap", word):
        rv = min(3, len(word))
    else:
        m = re.compile(v).search(word, 1)
        rv = m.end() if m else len(word)
    w = Word(word, vowels, rv)
    before = w.text
    if not _french_1(w) and not _french_i(w):
        _french_verb(w)
    if w.text != before:
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        _french_rest(w)
    w.text = re.sub("(enn|onn|ett|ell|eill)$", lambda m: m[0][:-1], w.text)
    w.text = re.sub(f"[éè]([^{vowels}]+)$", r"e\1", w.text)
    return w.text.lower()


def _french_1(w: Word) -> bool:
    """Whether a standard suffix went, other than an adverb's that leaves a verb's form behind."""
    s = w.longest(_FR_1)
    action = _FR_1.get(s or "")
    if not action:
        return False
    if action in ("plain", "log", "u", "ent"):
        return w.cut(s, w.r2, "" if action == "plain" else action)
    if action == "ic":
        return w.cut(s, w.r2) and (_or(w, "ic", "iqU") or True)
    if action == "ement":
        return w.cut(s, w.rv) and (_french_ement(w) or True)
    if action == "ite":
        return w.cut(s, w.r2) and (_or(w, "abil", "abl") or _or(w, "ic", "iqU") or w.cut("iv", w.r2) or True)
    if action == "if":
        return w.cut(s, w.r2) and ((w.cut("at", w.r2) and _or(w, "ic", "iqU")) or True)
    if action == "eaux":
        return w.cut(s, 0, "eau")
    if action == "aux":
        return w.cut(s, w.r1, "al")
    if action == "euse":
        return w.cut(s, w.r2) or w.cut(s, w.r1, "eux")
    base = w.text[: len(w.text) - len(s)]
    if action == "issement":
        return base[-1:] not in w.vowels and w.cut(s, w.r1)
    # adverbs: a verb's suffix is looked for in any case
    if action in ("amment", "emment"):
        w.cut(s, w.rv, action[0] + "nt")
    elif len(base) - 1 >= w.rv and base[-1:] in w.vowels:
        w.cut(s, 0)
    return False


def _or(w: Word, suffix: str, put: str) -> bool:
    """A suffix goes in R2; elsewhere it is replaced."""
    return w.cut(suffix, w.r2) or w.cut(suffix, 0, put)


def _french_ement(w: Word) -> None:
    if w.text.endswith("iv"):
        if w.cut("iv", w.r2):
            w.cut("at", w.r2)
    elif w.text.endswith("eus"):
        w.cut("eus", w.r2) or w.cut("eus", w.r1, "eux")
    elif not w.cut_one("abl iqU", w.r2):
        w.cut("ièr", w.rv, "i") or w.cut("Ièr", w.rv, "i")


def _french_i(w: Word) -> bool:
    s = w.longest(_FR_I, w.rv)
    if not s:
        return False
    at = len(w.text) - len(s) - 1
    return at >= w.rv and w.text[at] not in w.vowels and w.cut(s, 0)


def _french_verb(w: Word) -> None:
    s = w.longest([*_FR_E, *_FR_A, "ions"], w.rv)
    if s == "ions":
        w.cut(s, w.r2)
    elif s:
        w.cut(s, 0)
        if s in _FR_A:
            w.cut("e", w.rv)


def _french_rest(w: Word) -> None:
    if re.search("[^aiouès]s$", w.text):
        w.text = w.text[:-1]
    s = w.longest(["ion", "ier", "ière", "Ier", "Ière", "e"], w.rv)
    if s == "ion":
        if w.text[-4:-3] in ("s", "t") and len(w.text) - 4 >= w.rv:
            w.cut(s, w.r2)
    elif s == "e":
        w.cut(s, 0)
    elif s:
        w.cut(s, 0, "i")
