"""Snowball stemmers of the Romance languages, from their published descriptions."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Lists of suffixes, longest first, by their words in one string.
Suffixes = tuple[str, ...]


def listed(words: str) -> Suffixes:
    return tuple(sorted(words.split(), key=len, reverse=True))


def ending(word: str, suffixes: Suffixes, start: int = 0) -> str:
    """The longest of the suffixes that lies in the region from start on; empty if none does."""
    return next((x for x in suffixes if word.endswith(x) and len(word) - len(x) >= start), "")


def regions(word: str, vowels: frozenset[str]) -> tuple[int, int]:
    """Where the first and the second region begin."""
    marks, at = [], 0
    for _ in range(2):
        at = next((i + 1 for i in range(at + 1, len(word)) if word[i] not in vowels and word[i - 1] in vowels), len(word))
        marks.append(at)
    return marks[0], marks[1]


def verb_region(word: str, vowels: frozenset[str]) -> int:
    """Where the verb region begins in Spanish, Portuguese and Italian."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


@dataclass(frozen=True)
class Standard:
    """What becomes of a group of noun and adjective suffixes: the region they must lie in, what replaces them,
    and chains of endings that go as well while they lie in the second region."""

    suffixes: Suffixes
    region: str = "r2"
    new: str = ""
    chains: tuple[Suffixes, ...] = ()


def standard(word: str, groups: tuple[Standard, ...], at: dict[str, int]) -> str:
    """The word without its standard suffix; the word itself if it has none in the right region."""
    found = max(((ending(word, g.suffixes), g) for g in groups), key=lambda x: len(x[0]))
    suffix, group = found
    if not suffix or len(word) - len(suffix) < at[group.region]:
        return word
    word = word[: -len(suffix)] + group.new
    chain = next((c for c in sorted(group.chains, key=lambda c: -len(c[0])) if word.endswith(c[0])), ())
    for x in chain:
        if not word.endswith(x) or len(word) - len(x) < at["r2"]:
            break
        word = word[: -len(x)]
    return word


#: Fixed values of the Spanish description.
SPANISH_VOWELS = frozenset("aeiouáéíóúü")
SPANISH_PRONOUNS = listed("me se sela selo selas selos la le lo las les los nos")
SPANISH_GERUNDS, SPANISH_ACCENTED = listed("ando iendo ar er ir"), listed("iéndo ándo ár ér ír")
SPANISH_STANDARD = (
    Standard(listed("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")),
    Standard(listed("adora ador ación adoras adores aciones ante antes ancia ancias"), chains=(("ic",),)),
    Standard(listed("logía logías"), new="log"),
    Standard(listed("ución uciones"), new="u"),
    Standard(listed("encia encias"), new="ente"),
    Standard(("amente",), "r1", chains=(("iv", "at"), ("os",), ("ic",), ("ad",))),
    Standard(("mente",), chains=(("ante",), ("able",), ("ible",))),
    Standard(listed("idad idades"), chains=(("abil",), ("ic",), ("iv",))),
    Standard(listed("iva ivo ivas ivos"), chains=(("at",),)),
)
SPANISH_Y = listed("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
SPANISH_EN = listed("en es éis emos")
SPANISH_VERBS = listed(
    """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos
    eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase
    iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías
    aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos
    áramos iéramos iésemos ásemos"""
)
SPANISH_VERB_ENDS = listed(" ".join(SPANISH_EN + SPANISH_VERBS))
SPANISH_REST, SPANISH_E = listed("os a o á í ó"), ("e", "é")
UNACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    word = word.lower()
    r1, r2 = regions(word, SPANISH_VOWELS)
    rv = verb_region(word, SPANISH_VOWELS)
    pronoun = ending(word, SPANISH_PRONOUNS, rv)
    if pronoun:
        stem = word[: -len(pronoun)]
        accented = ending(stem, SPANISH_ACCENTED, rv)
        if accented:
            word = stem[: -len(accented)] + accented.translate(UNACUTE)
        elif ending(stem, SPANISH_GERUNDS, rv) or (ending(stem, ("yendo",), rv) and stem.endswith("uyendo")):
            word = stem
    before = word
    word = standard(word, SPANISH_STANDARD, {"r1": r1, "r2": r2, "rv": rv})
    if word == before:
        suffix = ending(word, SPANISH_Y, rv)
        if suffix and word[: -len(suffix)].endswith("u"):
            word = word[: -len(suffix)]
        else:
            suffix = ending(word, SPANISH_VERB_ENDS, rv)
            if suffix:
                word = word[: -len(suffix)]
                if suffix in SPANISH_EN and word.endswith("gu"):
                    word = word[:-1]
    suffix = ending(word, SPANISH_REST + SPANISH_E, rv)
    if suffix:
        word = word[: -len(suffix)]
        if suffix in SPANISH_E and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(UNACUTE)


#: Fixed values of the Portuguese description; a nasal vowel is a vowel and a tilde that counts as a consonant.
PORTUGUESE_VOWELS = frozenset("aeiouáéíóúâêô")
PORTUGUESE_STANDARD = (
    Standard(
        listed(
            """eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento
            imentos adora ador aça~o adoras adores aço~es ante antes ância"""
        )
    ),
    Standard(listed("logia logias"), new="log"),
    Standard(listed("uça~o uço~es"), new="u"),
    Standard(listed("ência ências"), new="ente"),
    Standard(("amente",), "r1", chains=(("iv", "at"), ("os",), ("ic",), ("ad",))),
    Standard(("mente",), chains=(("ante",), ("avel",), ("ível",))),
    Standard(listed("idade idades"), chains=(("abil",), ("ic",), ("iv",))),
    Standard(listed("iva ivo ivas ivos"), chains=(("at",),)),
)
PORTUGUESE_VERBS = listed(
    """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam
    eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er
    ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses
    isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis
    ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos
    iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"""
)
PORTUGUESE_REST, PORTUGUESE_E = listed("os a i o á í ó"), ("e", "é", "ê")


def portuguese(word: str) -> str:
    word = word.lower().replace("ã", "a~").replace("õ", "o~")
    r1, r2 = regions(word, PORTUGUESE_VOWELS)
    rv = verb_region(word, PORTUGUESE_VOWELS)
    before = word
    suffix = ending(word, ("iras", "ira"))
    if suffix and len(word) - len(suffix) >= rv and word[: -len(suffix)].endswith("e"):
        word = word[: -len(suffix)] + "ir"
    else:
        word = standard(word, PORTUGUESE_STANDARD, {"r1": r1, "r2": r2, "rv": rv})
    if word == before:
        suffix = ending(word, PORTUGUESE_VERBS, rv)
        word = word[: len(word) - len(suffix)]
    if word != before:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        word = word[: len(word) - len(ending(word, PORTUGUESE_REST, rv))]
    suffix = ending(word, PORTUGUESE_E, rv)
    if suffix:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


#: Fixed values of the Italian description.
ITALIAN_VOWELS = frozenset("aeiouàèìòù")
ITALIAN_PRONOUNS = listed(
    """ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele
    teli telo tene cela cele celi celo cene vela vele veli velo vene"""
)
ITALIAN_STANDARD = (
    Standard(
        listed(
            """anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso
            osi osa ose mente atrice atrici ante anti"""
        )
    ),
    Standard(listed("azione azioni atore atori"), chains=(("ic",),)),
    Standard(listed("logia logie"), new="log"),
    Standard(listed("uzione uzioni usione usioni"), new="u"),
    Standard(listed("enza enze"), new="ente"),
    Standard(listed("amento amenti imento imenti"), "rv"),
    Standard(("amente",), "r1", chains=(("iv", "at"), ("os",), ("ic",), ("abil",))),
    Standard(("ità",), chains=(("abil",), ("ic",), ("iv",))),
    Standard(listed("ivo ivi iva ive"), chains=(("at", "ic"),)),
)
ITALIAN_VERBS = listed(
    """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende
    endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo
    evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò
    irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto
    ar ir"""
)


def between_vowels(word: str, letters: str, vowels: frozenset[str]) -> str:
    """The word with the letters in capitals where they stand between vowels, and u after q."""
    out = ""
    for i, c in enumerate(word):
        inside = c in letters and out[-1:] in vowels and out != "" and word[i + 1 : i + 2] in vowels and i + 1 < len(word)
        out += c.upper() if inside or (c == "u" and out.endswith("q")) else c
    return out


def italian(word: str) -> str:
    word = between_vowels(word.lower().translate(str.maketrans("áéíóú", "àèìòù")), "ui", ITALIAN_VOWELS)
    r1, r2 = regions(word, ITALIAN_VOWELS)
    rv = verb_region(word, ITALIAN_VOWELS)
    pronoun = ending(word, ITALIAN_PRONOUNS, rv)
    stem = word[: len(word) - len(pronoun)]
    if pronoun and ending(stem, ("ando", "endo"), rv):
        word = stem
    elif pronoun and ending(stem, ("ar", "er", "ir"), rv):
        word = stem + "e"
    before = word
    word = standard(word, ITALIAN_STANDARD, {"r1": r1, "r2": r2, "rv": rv})
    if word == before:
        word = word[: len(word) - len(ending(word, ITALIAN_VERBS, rv))]
    if ending(word, tuple("aeioàèìò"), rv):
        word = word[:-1]
        word = word[:-1] if ending(word, ("i",), rv) else word
    if ending(word, ("ch", "gh"), rv):
        word = word[:-1]
    return word.lower()


#: Fixed values of the French description.
FRENCH_VOWELS = frozenset("aeiouyâàëéêèïîôûù")
FRENCH_DELETED = listed("ance iqUe isme able iste eux ances iqUes ismes ables istes")
FRENCH_ATION = listed("atrice ateur ation atrices ateurs ations")
FRENCH_I_VERBS = listed(
    """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais
    issait issant issante issantes issants isse issent isses issez issiez issions issons it"""
)
FRENCH_E_VERBS = listed("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
FRENCH_A_VERBS = listed("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
FRENCH_REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FRENCH_OTHERS = listed("ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
FRENCH_STANDARD = listed(" ".join((*FRENCH_DELETED, *FRENCH_ATION, *FRENCH_REPLACED, *FRENCH_OTHERS)))


def french_marked(word: str) -> str:
    """The word with capitals for u, i and y that are no vowels."""
    marked, out = between_vowels(word, "ui", FRENCH_VOWELS), ""
    for i, c in enumerate(marked):
        out += "Y" if c == "y" and ((out and out[-1] in FRENCH_VOWELS) or (i + 1 < len(marked) and marked[i + 1] in FRENCH_VOWELS)) else c
    return out


def french_standard(word: str, r1: int, r2: int, rv: int) -> tuple[str, bool]:
    """(the word, whether that settles it): adverbs lose their ending but go on to the verbs."""
    suffix = ending(word, FRENCH_STANDARD)
    if not suffix:
        return word, False
    stem, at = word[: -len(suffix)], len(word) - len(suffix)

    def second(x: str) -> bool:
        return stem.endswith(x) and len(stem) - len(x) >= r2

    if suffix in FRENCH_DELETED:
        return (stem, True) if at >= r2 else (word, False)
    if suffix in FRENCH_REPLACED:
        return (stem + FRENCH_REPLACED[suffix], True) if at >= r2 else (word, False)
    if suffix in FRENCH_ATION:
        if at < r2:
            return word, False
        if stem.endswith("ic"):
            stem = stem[:-2] if second("ic") else stem[:-2] + "iqU"
        return stem, True
    if suffix in ("ement", "ements"):
        if at < rv:
            return word, False
        if stem.endswith("iv"):
            if second("iv"):
                stem = stem[:-2]
                stem = stem[:-2] if second("at") else stem
        elif stem.endswith("eus"):
            stem = stem[:-3] if second("eus") else stem[:-3] + "eux" if len(stem) - 3 >= r1 else stem
        elif stem.endswith(("abl", "iqU")):
            stem = stem[:-3] if len(stem) - 3 >= r2 else stem
        elif stem.endswith(("ièr", "Ièr")) and len(stem) - 3 >= rv:
            stem = stem[:-3] + "i"
        return stem, True
    if suffix in ("ité", "ités"):
        if at < r2:
            return word, False
        if stem.endswith("abil"):
            stem = stem[:-4] if second("abil") else stem[:-4] + "abl"
        elif stem.endswith("ic"):
            stem = stem[:-2] if second("ic") else stem[:-2] + "iqU"
        elif second("iv"):
            stem = stem[:-2]
        return stem, True
    if suffix in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return word, False
        if second("at"):
            stem = stem[:-2]
            if stem.endswith("ic"):
                stem = stem[:-2] if second("ic") else stem[:-2] + "iqU"
        return stem, True
    if suffix == "eaux":
        return stem + "eau", True
    if suffix == "aux":
        return (stem + "al", True) if at >= r1 else (word, False)
    if suffix in ("euse", "euses"):
        return (stem, True) if at >= r2 else (stem + "eux", True) if at >= r1 else (word, False)
    if suffix in ("issement", "issements"):
        return (stem, True) if at >= r1 and stem[-1:] not in FRENCH_VOWELS else (word, False)
    if suffix in ("amment", "emment"):
        return (stem + ("ant" if suffix == "amment" else "ent"), False) if at >= rv else (word, False)
    # ment, ments
    return (stem, False) if at - 1 >= rv and stem[-1:] in FRENCH_VOWELS else (word, False)


def french_verb(word: str, r2: int, rv: int) -> tuple[str, bool]:
    """(the word, whether it lost a verb's ending)."""
    suffix = ending(word, FRENCH_I_VERBS, rv)
    stem = word[: len(word) - len(suffix)]
    if suffix and len(stem) - 1 >= rv and stem[-1] not in FRENCH_VOWELS:
        return stem, True
    suffix = max(ending(word, FRENCH_E_VERBS, rv), ending(word, FRENCH_A_VERBS, rv), ending(word, ("ions",), rv), key=len)
    if not suffix:
        return word, False
    stem = word[: -len(suffix)]
    if suffix == "ions":
        return (stem, True) if len(stem) >= r2 else (word, False)
    if suffix in FRENCH_A_VERBS and ending(stem, ("e",), rv):
        stem = stem[:-1]
    return stem, True


def french_rest(word: str, r2: int, rv: int) -> str:
    """The word without a plural and a last e."""
    if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
        word = word[:-1]
    suffix = ending(word, listed("ion ier ière Ier Ière e ë"), rv)
    stem = word[: len(word) - len(suffix)]
    if suffix == "ion":
        return stem if len(stem) >= r2 and len(stem) - 1 >= rv and stem.endswith(("s", "t")) else word
    if suffix == "e":
        return stem
    if suffix == "ë":
        return stem if stem.endswith("gu") and len(stem) - 2 >= rv else word
    return stem + "i" if suffix else word


def french(word: str) -> str:
    word = french_marked(word.lower())
    r1, r2 = regions(word, FRENCH_VOWELS)
    if word.startswith(("par", "col", "tap")) or (len(word) > 2 and word[0] in FRENCH_VOWELS and word[1] in FRENCH_VOWELS):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(word)) if word[i] in FRENCH_VOWELS), len(word))
    word, settled = french_standard(word, r1, r2, rv)
    if not settled:
        word, settled = french_verb(word, r2, rv)
    if not settled:
        word = french_rest(word, r2, rv)
    elif word.endswith("Y"):
        word = word[:-1] + "i"
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    found = re.search(f"[éè]([^{''.join(sorted(FRENCH_VOWELS))}]+)$", word)
    return (word[: found.start()] + "e" + found[1] if found else word).lower()
