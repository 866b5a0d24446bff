"""Stemmers of the published Snowball family for fourteen languages, as one small engine and a rule set each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region begins that follows the first non-vowel after a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _regions(word: str, vowels: str, least: int = 0) -> tuple[int, int]:
    r1 = _after(word, vowels)
    r2 = _after(word, vowels, r1)
    return max(r1, min(least, len(word))), r2


def _suffix(word: str, suffixes: tuple[str, ...] | list[str]) -> str:
    """The longest of the suffixes that the word ends with."""
    best = ""
    for s in suffixes:
        if len(s) > len(best) and word.endswith(s):
            best = s
    return best


def _rv_romance(word: str, vowels: str) -> int:
    """Second letter a consonant: after the next vowel; first two vowels: after the next consonant; else after three."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# ---------------------------------------------------------------- English
_EN_V = "aeiouy"
# The algorithm's own exceptions and suffix tables.
_EN_SPECIAL = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
_EN_STOP_1A = set(_words("inning outing canning herring earring proceed exceed succeed"))
_EN_2 = dict(x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split())
_EN_3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
_EN_4 = _words("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
_EN_DOUBLE = _words("bb dd ff gg mm nn pp rr tt")


def _en_short_end(w: str) -> bool:
    v = _EN_V
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1, r2 = len(start), _after(w, _EN_V, len(start))
            break
    else:
        r1, r2 = _regions(w, _EN_V)
    has_vowel = lambda x: any(c in _EN_V for c in x)
    w = w[: len(w) - len(_suffix(w, ("'", "'s", "'s'")))]
    s = _suffix(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _EN_STOP_1A:
        return w
    s = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLE):
            w = w[:-1]
        elif _en_short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    s = _suffix(w, list(_EN_2))
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[: -len(s)].endswith("l")) and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + _EN_2[s]
    s = _suffix(w, list(_EN_3))
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + _EN_3[s]
    s = _suffix(w, _EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _en_short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# ---------------------------------------------------------------- German and Dutch
def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v, 3)
    s = _suffix(w, _words("em ern er e en es s"))
    if s and len(w) - len(s) >= r1:
        if s == "s":
            if w[-2:-1] in tuple("bdfghklmnrt"):
                w = w[:-1]
        else:
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    s = _suffix(w, _words("en er est st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _suffix(w, _words("end ung ig ik isch lich heit keit"))
    if s and len(w) - len(s) >= r2:
        head = w[: -len(s)]
        if s in ("end", "ung"):
            w = head[:-2] if head.endswith("ig") and not head.endswith("eig") and len(head) - 2 >= r2 else head
        elif s in ("ig", "ik", "isch"):
            w = w if head.endswith("e") else head
        elif s in ("lich", "heit"):
            w = head[:-2] if head.endswith(("er", "en")) and len(head) - 2 >= r1 else head
        else:
            t = _suffix(head, ("lich", "ig"))
            w = head[: -len(t)] if t and len(head) - len(t) >= r2 else head
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(rf"(^|(?<=[{v}]))y", "Y", w)
    w = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", w)
    r1, r2 = _regions(w, v, 3)
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def drop_en(x: str, n: int) -> str:
        head = x[:-n]
        return undouble(head) if len(head) >= r1 and head and head[-1] not in v and not head.endswith("gem") else x

    s = _suffix(w, _words("heden en ene s se"))
    if s == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = drop_en(w, len(s))
    elif s and len(w) - len(s) >= r1 and w[-len(s) - 1] not in v + "j":
        w = w[: -len(s)]
    removed_e = False

    def drop_e(x: str) -> str:
        nonlocal removed_e
        if x.endswith("e") and len(x) - 1 >= r1 and len(x) > 1 and x[-2] not in v:
            removed_e = True
            return undouble(x[:-1])
        return x

    w = drop_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = drop_en(w, 2)
    s = _suffix(w, _words("end ing ig lijk baar bar"))
    if s and len(w) - len(s) >= r2:
        head = w[: -len(s)]
        if s in ("end", "ing"):
            w = head[:-2] if head.endswith("ig") and len(head) - 2 >= r2 and not head.endswith("eig") else undouble(head)
        elif s == "ig":
            w = w if head.endswith("e") else head
        elif s == "lijk":
            w = drop_e(head)
        elif s == "baar" or removed_e:
            w = head
    if len(w) >= 4 and w[-1] not in v + "I" and w[-2] == w[-3] and w[-2] in "aeou" and w[-4] not in v:
        w = w[:-2] + w[-1]
    return w.replace("I", "i").replace("Y", "y")


# ---------------------------------------------------------------- Scandinavian
def swedish(word: str) -> str:
    w = word
    r1, _ = _regions(w, "aeiouyäåö", 3)
    s = _suffix(w[r1:], _words("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s"))
    if s and (s != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[: -len(s)]
    if _suffix(w[r1:], _words("dd gd nn dt gt kt tt")):
        w = w[:-1]
    s = _suffix(w[r1:], _words("lig ig els löst fullt"))
    return w[:-1] if s in ("löst", "fullt") else w[: -len(s)] if s else w


def norwegian(word: str) -> str:
    v, w = "aeiouyæåø", word
    r1, _ = _regions(w, v, 3)
    s = _suffix(w[r1:], _words("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert"))
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        w = w[:-1] if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] not in tuple(v) else w
    elif s:
        w = w[: -len(s)]
    if _suffix(w[r1:], ("dt", "vt")):
        w = w[:-1]
    s = _suffix(w[r1:], _words("leg eleg ig eig lig elig els lov elov slov hetslov"))
    return w[: -len(s)] if s else w


def danish(word: str) -> str:
    v, w = "aeiouyæåø", word
    r1, _ = _regions(w, v, 3)
    s = _suffix(w[r1:], _words("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s"))
    if s and (s != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[: -len(s)]
    pair = lambda x: x[:-1] if _suffix(x[r1:], _words("gd dt gt kt")) else x
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _suffix(w[r1:], _words("ig lig elig els løst"))
    if s == "løst":
        w = w[:-1]
    elif s:
        w = pair(w[: -len(s)])
    if len(w) - 1 > r1 - 1 and len(w) > r1 and len(w) >= 2 and w[-1] == w[-2] and w[-1] not in v:
        w = w[:-1]
    return w


# ---------------------------------------------------------------- Russian
_RU_V = "аеиоуыэюя"
_RU_GERUND_1, _RU_GERUND_2 = _words("в вши вшись"), _words("ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = _words("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE_1, _RU_PARTICIPLE_2 = _words("ем нн вш ющ щ"), _words("ивш ывш ующ")
_RU_VERB_1 = _words("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно")
_RU_VERB_2 = _words("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = _words("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _ru_cut(rv: str, guarded: tuple[str, ...], free: tuple[str, ...]) -> str | None:
    """``rv`` without the longest suffix; those of ``guarded`` only after а or я."""
    best = _suffix(rv, free)
    for s in guarded:
        if len(s) > len(best) and rv.endswith(s) and rv[: -len(s)].endswith(("а", "я")):
            best = s
    return rv[: -len(best)] if best else None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    at = next((i + 1 for i, c in enumerate(w) if c in _RU_V), len(w))
    head, rv = w[:at], w[at:]
    _, r2 = _regions(w, _RU_V)
    cut = _ru_cut(rv, _RU_GERUND_1, _RU_GERUND_2)
    if cut is None:
        if s := _suffix(rv, ("ся", "сь")):
            rv = rv[: -len(s)]
        if s := _suffix(rv, _RU_ADJECTIVE):
            cut = rv[: -len(s)]
            cut = part if (part := _ru_cut(cut, _RU_PARTICIPLE_1, _RU_PARTICIPLE_2)) is not None else cut
        else:
            cut = _ru_cut(rv, _RU_VERB_1, _RU_VERB_2)
            if cut is None:
                s = _suffix(rv, _RU_NOUN)
                cut = rv[: -len(s)] if s else rv
    rv = cut.removesuffix("и")
    if (s := _suffix(rv, ("ост", "ость"))) and len(head) + len(rv) - len(s) >= r2:
        rv = rv[: -len(s)]
    if s := _suffix(rv, ("ейш", "ейше")):
        rv = rv[: -len(s)]
    rv = rv[:-1] if rv.endswith(("нн", "ь")) else rv
    return head + rv


# ---------------------------------------------------------------- Romance
def _acute_off(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


_ES_PRONOUN = _words("me se sela selo selas selos la le lo las les los nos")
_ES_1 = {
    "": _words("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    "ic": _words("adora ador ación adoras adores aciones ante antes ancia ancias"),
    "log": _words("logía logías"), "u": _words("ución uciones"), "ente": _words("encia encias"),
    "amente": ("amente",), "mente": ("mente",), "idad": ("idad", "idades"), "iv": _words("iva ivo ivas ivos"),
}
_ES_Y = _words("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_2B = _words(
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w = word
    rv, (r1, r2) = _rv_romance(w, v), _regions(w, v)
    s = _suffix(w[rv:], _ES_PRONOUN)
    if s:
        head = w[: -len(s)]
        t = _suffix(head[rv:], _words("iéndo ándo ár ér ír ando iendo ar er ir yendo"))
        if t == "yendo":
            w = head if head.endswith("uyendo") else w
        elif t:
            w = head[: -len(t)] + _acute_off(t)
    before = w
    kind, s = max(((k, _suffix(w, x)) for k, x in _ES_1.items()), key=lambda x: len(x[1]))
    at = len(w) - len(s)
    if s and (kind == "amente" and at >= r1 or kind != "amente" and at >= r2):
        w = w[:at]
        drop = lambda *xs: next((w[: -len(x)] for x in xs if w.endswith(x) and len(w) - len(x) >= r2), w)
        if kind == "ic":
            w = drop("ic")
        elif kind in ("log", "u", "ente"):
            w += kind
        elif kind == "amente":
            w = drop("ativ", "iv", "os", "ic", "ad")
        elif kind == "mente":
            w = drop("ante", "able", "ible")
        elif kind == "idad":
            w = drop("abil", "ic", "iv")
        elif kind == "iv":
            w = drop("at")
    if w == before:
        s = _suffix(w[rv:], _ES_Y)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _suffix(w[rv:], _ES_2B)
            if s:
                w = w[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    s = _suffix(w[rv:], _words("os a o á í ó e é"))
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return _acute_off(w)


_PT_1 = {
    "": _words("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"),
    "log": _words("logia logias"), "u": _words("uça~o uço~es"), "ente": _words("ência ências"), "amente": ("amente",), "mente": ("mente",), "idade": ("idade", "idades"),
    "iv": _words("iva ivo ivas ivos"), "ir": _words("ira iras"),
}
_PT_2 = _words(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, (r1, r2) = _rv_romance(w, v), _regions(w, v)
    before = w
    kind, s = max(((k, _suffix(w, x)) for k, x in _PT_1.items()), key=lambda x: len(x[1]))
    at = len(w) - len(s)
    able = at >= r1 if kind == "amente" else at >= rv and w[:at].endswith("e") if kind == "ir" else at >= r2
    if s and able:
        w = w[:at]
        drop = lambda *xs: next((w[: -len(x)] for x in xs if w.endswith(x) and len(w) - len(x) >= r2), w)
        if kind in ("log", "u", "ente", "ir"):
            w += kind
        elif kind == "amente":
            w = drop("ativ", "iv", "os", "ic", "ad")
        elif kind == "mente":
            w = drop("ante", "avel", "ível")
        elif kind == "idade":
            w = drop("abil", "ic", "iv")
        elif kind == "iv":
            w = drop("at")
    changed = w != before
    if not changed and (s := _suffix(w[rv:], _PT_2)):
        w, changed = w[: -len(s)], True
    if changed:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif s := _suffix(w[rv:], _words("os a i o á í ó")):
        w = w[: -len(s)]
    s = _suffix(w[rv:], _words("e é ê"))
    if s:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_IT_PRONOUN = _words("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_1 = {
    "": _words("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"),
    "ic": _words("azione azioni atore atori"), "log": _words("logia logie"), "u": _words("uzione uzioni usione usioni"), "ente": _words("enza enze"),
    "rv": _words("amento amenti imento imenti"), "amente": ("amente",), "ità": ("ità",), "iv": _words("ivo ivi iva ive"),
}
_IT_2 = _words(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    rv, (r1, r2) = _rv_romance(w, v), _regions(w, v)
    s = _suffix(w[rv:], _IT_PRONOUN)
    if s:
        head = w[: -len(s)]
        if head[rv:].endswith(("ando", "endo")):
            w = head
        elif head[rv:].endswith(("ar", "er", "ir")):
            w = head + "e"
    before = w
    kind, s = max(((k, _suffix(w, x)) for k, x in _IT_1.items()), key=lambda x: len(x[1]))
    at = len(w) - len(s)
    if s and at >= {"amente": r1, "rv": rv}.get(kind, r2):
        w = w[:at]
        drop = lambda *xs: next((w[: -len(x)] for x in xs if w.endswith(x) and len(w) - len(x) >= r2), w)
        if kind == "ic":
            w = drop("ic")
        elif kind in ("log", "u", "ente"):
            w += kind
        elif kind == "amente":
            w = drop("ativ", "iv", "os", "ic", "abil")
        elif kind == "ità":
            w = drop("abil", "ic", "iv")
        elif kind == "iv":
            short = drop("at")
            w = short[:-2] if short != w and short.endswith("ic") and len(short) - 2 >= r2 else short
    if w == before and (s := _suffix(w[rv:], _IT_2)):
        w = w[: -len(s)]
    if len(w) - 1 >= rv and w[-1:] in tuple("aeioàèìò"):
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


_FR_1 = {
    "": _words("ance iqUe isme able iste eux ances iqUes ismes ables istes"), "ic": _words("atrice ateur ation atrices ateurs ations"), "log": _words("logie logies"),
    "u": _words("usion ution usions utions"), "ent": _words("ence ences"), "ement": _words("ement ements"), "ité": _words("ité ités"), "iv": _words("if ive ifs ives"),
    "eau": ("eaux",), "al": ("aux",), "eus": _words("euse euses"), "iss": _words("issement issements"), "ant": ("amment",), "en": ("emment",), "m": _words("ment ments"),
}
_FR_2A = _words("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_2B_E = _words("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_2B_A = _words("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    w = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    w = w.replace("qu", "qU")
    if w.startswith(("par", "col", "tap")) or len(w) > 1 and w[0] in v and w[1] in v:
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1, r2 = _regions(w, v)
    before, verbs = w, False
    kind, s = max(((k, _suffix(w, x)) for k, x in _FR_1.items()), key=lambda x: len(x[1]))
    at = len(w) - len(s)
    ends = lambda x: w.endswith(x) and len(w) - len(x) >= r2
    if s:
        if kind in ("", "ic", "log", "u", "ent") and at >= r2:
            w = w[:at] + (kind if kind in ("log", "u", "ent") else "")
            if kind == "ic" and w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "ement" and at >= rv:
            w = w[:at]
            if ends("iv"):
                w = w[:-2]
                w = w[:-2] if ends("at") else w
            elif w.endswith("eus"):
                w = w[:-3] if ends("eus") else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif ends("abl") or ends("iqU"):
                w = w[:-3]
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
        elif kind == "ité" and at >= r2:
            w = w[:at]
            if w.endswith("abil"):
                w = w[:-4] if ends("abil") else w[:-2] + "l"
            elif w.endswith("ic"):
                w = w[:-2] if ends("ic") else w[:-2] + "iqU"
            elif ends("iv"):
                w = w[:-2]
        elif kind == "iv" and at >= r2:
            w = w[:at]
            if ends("at"):
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if ends("ic") else w[:-2] + "iqU"
        elif kind == "eau":
            w = w[:-1]
        elif kind == "al" and at >= r1:
            w = w[:-2] + "l"
        elif kind == "eus":
            w = w[:at] if at >= r2 else w[:at] + "eux" if at >= r1 else w
        elif kind == "iss" and at >= r1 and at and w[at - 1] not in v:
            w = w[:at]
        elif kind in ("ant", "en") and at >= rv:
            w, verbs = w[:at] + ("ant" if kind == "ant" else "ent"), True
        elif kind == "m" and at - 1 >= rv and w[at - 1] in v:
            w, verbs = w[:at], True
    changed = w != before
    if not changed or verbs:
        start = w
        s = _suffix(w[rv:], _FR_2A)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in v:
            w = w[: -len(s)]
        else:
            options = [("ions", ("ions",)), ("e", _FR_2B_E), ("a", _FR_2B_A)]
            which, s = max(((k, _suffix(w[rv:], x)) for k, x in options), key=lambda x: len(x[1]))
            if s and which == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s:
                w = w[: -len(s)]
                if which == "a" and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = changed or w != start
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s = _suffix(w[rv:], _words("ion ier ière Ier Ière e ë"))
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[:-3].endswith(("s", "t")) and len(w) - 4 >= rv else w
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e":
            w = w[:-1]
        elif s == "ë" and w[:-1].endswith("gu"):
            w = w[:-1]
    if w.endswith(_words("enn onn ett ell eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{v}]+)$", r"e\1", w)
    return w.replace("I", "i").replace("U", "u").replace("Y", "y")


_RO_0 = dict(x.split(":") for x in "ul: ului: aua:a ea:e ele:e elor:e ii:i iua:i iei:i iile:i iilor:i ilor:i ile:i atei:at aţie:aţi aţia:aţi".split())
_RO_COMBO = {
    "abil": _words("abilitate abilitati abilităi abilităţi"), "ibil": ("ibilitate",), "iv": _words("ivitate ivitati ivităi ivităţi"),
    "ic": _words("icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală"),
    "at": _words("ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători"), "it": _words("itiv itiva itive itivi itivă iţiune itoare itor itori"),
}
_RO_1 = {
    "": _words("at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă"),
    "ţ": _words("iune iuni"), "ist": _words("ism isme ist ista iste isti istă işti"),
}
_RO_VERB = _words("ând ind indu ându ea ez eze ească eşte eşti esc are ere ire âre ase ise use âse aseşi iseşi useşi âseşi asem isem usem âsem aseră iseră useră âseră aserăm iserăm userăm âserăm aserăţi iserăţi userăţi âserăţi a ai am au eai eam eau ia iam iau ui ut uri urăm urăţi ură arăm arăţi ară aşi irăm irăţi iră işi i ăm ăţi em eţi im iţi âm âţi ăsc ăşte ăşti")


def romanian(word: str) -> str:
    v = "aeiouăâî"
    w = word.replace("ș", "ş").replace("ț", "ţ")
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    rv, (r1, r2) = _rv_romance(w, v), _regions(w, v)
    s = _suffix(w, list(_RO_0))
    if s and len(w) - len(s) >= r1 and not (s == "ile" and w.endswith("abile")):
        w = w[: -len(s)] + _RO_0[s]
    removed = False
    for _ in range(10):
        kind, s = max(((k, _suffix(w, x)) for k, x in _RO_COMBO.items()), key=lambda x: len(x[1]))
        if not s or len(w) - len(s) < r1:
            break
        w, removed = w[: -len(s)] + kind, True
    kind, s = max(((k, _suffix(w, x)) for k, x in _RO_1.items()), key=lambda x: len(x[1]))
    if s and len(w) - len(s) >= r2 and (kind != "ţ" or w[: -len(s)].endswith("ţ")):
        head = w[: -len(s)]
        w, removed = (head[:-1] + "t" if kind == "ţ" else head + ("ist" if kind == "ist" else "")), True
    if not removed and (s := _suffix(w[rv:], _RO_VERB)):
        w = w[: -len(s)]
    if s := _suffix(w[rv:], _words("a e i ie ă")):
        w = w[: -len(s)]
    return w.replace("I", "i").replace("U", "u")


# ---------------------------------------------------------------- Finnish and Hungarian
def finnish(word: str) -> str:
    v = "aeiouyäö"
    w = word
    r1, r2 = _regions(w, v)
    s = _suffix(w[r1:], _words("kin kaan kään ko kö han hän pa pä sti"))
    if s == "sti":
        w = w[:-3] if len(w) - 3 >= r2 else w
    elif s and w[: -len(s)][-1:] in tuple(v + "nt"):
        w = w[: -len(s)]
    s = _suffix(w[r1:], _words("si ni nsa nsä mme nne an än en"))
    if s == "si":
        w = w if w[:-2].endswith("k") else w[:-2]
    elif s == "ni":
        w = w[:-2]
        w = w[:-3] + "ksi" if w.endswith("kse") else w
    elif s in ("an", "än", "en"):
        ok = {"an": _words("ta ssa sta lla lta na"), "än": _words("tä ssä stä llä ltä nä"), "en": _words("lle ine")}[s]
        w = w[:-1] if w[:-1].endswith(ok) else w
    elif s:
        w = w[: -len(s)]
    case = False
    s = _suffix(w[r1:], _words("han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n"))
    long = _words("aa ee ii oo uu ää öö")
    if s:
        head = w[: -len(s)]
        if s in ("han", "hen", "hin", "hon", "hän", "hön"):
            case = head.endswith(s[1])
        elif s in ("siin", "den", "tten"):
            case = len(head) > 1 and head[-1] == "i" and head[-2] in v
        elif s == "seen":
            case = head.endswith(long)
        elif s in ("a", "ä"):
            case = len(head) > 1 and head[-1] in v and head[-2] not in v
        elif s in ("tta", "ttä"):
            case = head.endswith("e")
        else:
            case = True
        if case:
            if s == "n" and (head.endswith(long) or head.endswith("ie")):
                head = head[:-1]
            w = head
    s = _suffix(w[r2:], _words("mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä"))
    if s and not (s in _words("mpi mpa mpä mmi mma mmä") and w[: -len(s)].endswith("po")):
        w = w[: -len(s)]
    if case:
        if w[-1:] in ("i", "j") and len(w) - 1 >= r1:
            w = w[:-1]
    elif w.endswith("t") and len(w) - 1 >= r1 and w[-2:-1] in tuple(v):
        w = w[:-1]
        s = _suffix(w[r2:], ("mma", "imma"))
        if s and not (s == "mma" and w[:-3].endswith("po")):
            w = w[: -len(s)]
    if w.endswith(long) and len(w) - 2 >= r1:
        w = w[:-1]
    if len(w) > 1 and len(w) - 1 >= r1 and w[-1] in "aäei" and w[-2] not in v:
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= r1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= r1:
        w = w[:-1]
    for i in range(len(w) - 1, 0, -1):
        if w[i] not in v:
            if w[i] == w[i - 1]:
                w = w[:i] + w[i + 1 :]
            break
    return w


_HU_DOUBLE = _words("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs")
_HU_CASE = _words("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t")
_HU_OWNED = _words("oké öké aké eké ké éi é")
_HU_SINGLE = _words("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o")
_HU_MANY = _words("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik")


def hungarian(word: str) -> str:
    v = "aáeéiíoóöőuúüű"
    w = word
    if w[:1] and w[0] in v:
        r1 = next((i + (2 if w[i : i + 2] in ("cs", "gy", "ly", "ny", "sz", "ty", "zs") else 1) for i in range(1, len(w)) if w[i] not in v), len(w))
    else:
        r1 = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    mend = lambda x: x[:-1] + {"á": "a", "é": "e"}[x[-1]] if x[-1:] in ("á", "é") and len(x) - 1 >= r1 - 1 else x
    single = lambda x: x[:-2] + x[-1] if x.endswith(_words("bb cc dd ff gg jj kk ll mm nn pp rr ss tt vv zz")) else x[: -len(t)] + t[1:] if (t := _suffix(x, _words("ccs ggy lly nny ssz tty zzs"))) else x
    if (s := _suffix(w[r1:], ("al", "el"))) and w[:-2].endswith(_HU_DOUBLE):
        w = single(w[:-2])
    elif s := _suffix(w[r1:], _HU_CASE):
        w = mend(w[: -len(s)])
    if s := _suffix(w[r1:], _words("án én ánként")):
        w = w[: -len(s)] + ("e" if s == "én" else "a")
    if s := _suffix(w[r1:], _words("astul estül stul stül ástul éstül")):
        w = w[: -len(s)] + {"á": "a", "é": "e"}.get(s[0], "")
    if (s := _suffix(w[r1:], ("á", "é"))) and w[:-1].endswith(_HU_DOUBLE):
        w = single(w[:-1])
    for table in (_HU_OWNED, _HU_SINGLE, _HU_MANY):
        if s := _suffix(w[r1:], table):
            w = mend(w[: -len(s)])
    if s := _suffix(w[r1:], _words("ák ék ök ok ek ak k")):
        w = w[: -len(s)] + {"ák": "a", "ék": "e"}.get(s, "")
    return w


STEMMERS: dict[str, Callable[[str], str]] = {
    "da": danish, "de": german, "en": english, "es": spanish, "fi": finnish, "fr": french, "hu": hungarian,
    "it": italian, "nl": dutch, "no": norwegian, "pt": portuguese, "ro": romanian, "ru": russian, "sv": swedish,
}


def stem(word: str, language: str) -> str:
    """The stem of a word in lower case; as it is for an unknown language."""
    known = STEMMERS.get(language)
    return known(word.lower()) if known else word


def _stem_lists(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for tokens, languages in parts:
        seen: dict[tuple[str, str], str] = {}  # each word of a batch is stemmed once
        for ts, x in zip(tokens, languages, strict=True):
            if ts is not None and x in STEMMERS:
                for t in ts:
                    if t is not None and (t, x) not in seen:
                        seen[t, x] = stem(t, x)
        yield pd.Series([[seen[t, x] for t in ts if t is not None] if ts is not None and x in STEMMERS else [] for ts, x in zip(tokens, languages, strict=True)], dtype=object)


def stem_tokens(tokens: Column, language: Column) -> Column:
    """One stem a token under the record's language code; an empty list for an unknown or missing language or no tokens."""
    return F.pandas_udf(_stem_lists, "array<string>", F.PandasUDFType.SCALAR_ITER)(tokens, language)
