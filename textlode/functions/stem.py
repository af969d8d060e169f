"""Snowball stemmers from their published descriptions, and their application to distinct terms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stem_more import dutch, porter, russian
from .stem_romance import french, italian, portuguese, spanish

VOWELS = frozenset("aeiouy")
#: Fixed values of the description: doubles, letters before a removable "li", exceptions.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def short_syllable_ends(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    word = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    # a y that begins the word or follows a vowel is a consonant
    marked = ""
    for i, c in enumerate(word):
        marked += "Y" if c == "y" and (i == 0 or marked[i - 1] in VOWELS) else c
    word = marked
    r1 = next((len(p) for p in R1_PREFIXES if word.startswith(p)), None)
    r1 = region(word, 0) if r1 is None else r1
    r2 = region(word, r1)

    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    if word.endswith(("eedly", "eed")):
        suffix = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if any(c in VOWELS for c in stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(DOUBLES):
                        word = word[:-1]
                    elif short_syllable_ends(word) and r1 >= len(word):
                        word += "e"
                break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    for suffix, new in STEP2:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                stem = word[: -len(suffix)]
                if suffix == "ogi":
                    word = stem + new if stem.endswith("l") else word
                elif suffix == "li":
                    word = stem if stem and stem[-1] in LI_ENDINGS else word
                else:
                    word = stem + new
            break
    # 3
    for suffix, new in STEP3:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                word = word[:at] + new
            break
    # 4
    for suffix in STEP4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short_syllable_ends(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def longest(word: str, suffixes: tuple[str, ...], start: int) -> str:
    """The longest of the suffixes that lies in the region from start on; empty if none does."""
    return max((x for x in suffixes if word.endswith(x) and len(word) - len(x) >= start), key=len, default="")


def first_region(word: str, vowels: frozenset[str]) -> int:
    """Where the first region begins, with three letters before it at least."""
    for i in range(1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return max(3, i + 1)
    return len(word)


#: Fixed values of the descriptions.
SWEDISH = {
    "vowels": frozenset("aeiouyäåö"), "s": frozenset("bcdfghjklmnoprtvy"),
    "1": tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()),
    "2": tuple("dd gd nn dt gt kt tt".split()), "3": ("lig", "ig", "els"), "cut": {"löst": 1, "fullt": 1},
}
NORWEGIAN = {
    "vowels": frozenset("aeiouyæåø"), "s": frozenset("bcdfghjlmnoprtvyz"),
    "1": tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()),
    "2": ("dt", "vt"), "3": tuple("leg eleg ig eig lig elig els lov elov slov hetslov".split()), "cut": {},
}
DANISH = {
    "vowels": frozenset("aeiouyæåø"), "s": frozenset("abcdfghjklmnoprtvyzå"),
    "1": tuple("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()),
    "2": ("gd", "dt", "gt", "kt"), "3": ("ig", "lig", "elig", "els"), "cut": {"løst": 1},
}


def nordic(word: str, rules: dict) -> str:
    """The shared frame of the Swedish, Norwegian and Danish stemmers."""
    word, vowels = word.lower(), rules["vowels"]
    r1 = first_region(word, vowels)
    extra = ("erte", "ert") if rules is NORWEGIAN else ()
    found = longest(word, (*rules["1"], "s", *extra), r1)
    if found in extra and found:
        word = word[: -len(found)] + "er"
    elif found == "s":
        before = word[-2:-1]
        if before in rules["s"] or (rules is NORWEGIAN and before == "k" and word[-3:-2] not in vowels and len(word) > 2):
            word = word[:-1]
    elif found:
        word = word[: -len(found)]

    def pair(word: str) -> str:
        return word[:-1] if longest(word, rules["2"], r1) else word

    word = pair(word)
    if rules is DANISH and word.endswith("igst"):
        word = word[:-2]
    found = longest(word, (*rules["3"], *rules["cut"]), r1)
    if found in rules["cut"]:
        word = word[: -rules["cut"][found]]
    elif found:
        word = word[: -len(found)]
        word = pair(word) if rules is DANISH else word
    if rules is DANISH and len(word) >= 2 and word[-1] == word[-2] and word[-1] not in vowels and len(word) - 1 >= r1:
        word = word[:-1]
    return word


#: Fixed values of the German description.
GERMAN_VOWELS, GERMAN_S, GERMAN_ST = frozenset("aeiouyäöü"), frozenset("bdfghklmnrt"), frozenset("bdfghklmnt")


def german(word: str) -> str:
    word = word.lower().replace("ß", "ss")
    word = "".join(c.upper() if c in "uy" and 0 < i < len(word) - 1 and word[i - 1] in GERMAN_VOWELS and word[i + 1] in GERMAN_VOWELS else c for i, c in enumerate(word))
    r1 = next((i + 1 for i in range(1, len(word)) if word[i] not in GERMAN_VOWELS and word[i - 1] in GERMAN_VOWELS), len(word))
    r2 = next((i + 1 for i in range(r1 + 1, len(word)) if word[i] not in GERMAN_VOWELS and word[i - 1] in GERMAN_VOWELS), len(word))
    r1 = max(3, r1)
    found = longest(word, ("em", "ern", "er", "e", "en", "es", "s"), 0)
    if found and len(word) - len(found) >= r1:
        if found != "s":
            word = word[: -len(found)]
            if found in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
        elif word[-2:-1] in GERMAN_S:
            word = word[:-1]
    found = longest(word, ("en", "er", "est", "st"), 0)
    if found and len(word) - len(found) >= r1 and (found != "st" or (word[-3:-2] in GERMAN_ST and len(word) >= 6)):
        word = word[: -len(found)]
    found = longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), 0)
    stem = word[: len(word) - len(found)] if found else word
    if found and len(stem) >= r2:
        if found in ("end", "ung"):
            word = stem
            if word.endswith("ig") and len(word) - 2 >= r2 and word[-3:-2] != "e":
                word = word[:-2]
        elif found in ("ig", "ik", "isch"):
            word = stem if stem[-1:] != "e" else word
        elif found in ("lich", "heit"):
            word = stem
            if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
        else:
            word = stem
            for suffix in ("lich", "ig"):
                if word.endswith(suffix) and len(word) - len(suffix) >= r2:
                    word = word[: -len(suffix)]
                    break
    return word.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


STEMMERS = {
    "english": english,
    "german": german,
    "swedish": lambda word: nordic(word, SWEDISH),
    "norwegian": lambda word: nordic(word, NORWEGIAN),
    "danish": lambda word: nordic(word, DANISH),
    "dutch": dutch,
    "french": french,
    "italian": italian,
    "porter": porter,
    "portuguese": portuguese,
    "russian": russian,
    "spanish": spanish,
}


def check_language(language: str | None) -> None:
    if language is not None and language not in STEMMERS:
        raise ValueError(f"no stemmer for {language!r}; there is one for {', '.join(STEMMERS)}")


def stem_terms(terms: DataFrame, language: str = "english") -> DataFrame:
    """(term, stem) of distinct terms."""
    check_language(language)

    @F.pandas_udf(StringType())
    def stem(column: pd.Series) -> pd.Series:
        return column.map(STEMMERS[language])

    return terms.select("term").distinct().select("term", stem("term").alias("stem"))


def stem_arrays(tokens, language: str = "english"):
    """Arrays of stems in place of arrays of terms, in their order; a null array stays null."""
    check_language(language)
    memo: dict[str, str] = {}  # one for each worker's copy of the function

    @F.pandas_udf(ArrayType(StringType()))
    def stem(column: pd.Series) -> pd.Series:
        of = STEMMERS[language]
        if len(memo) > 200_000:
            memo.clear()
        out = []
        for terms in column:
            for t in () if terms is None else set(terms).difference(memo):
                memo[t] = of(t)
            out.append(None if terms is None else [memo[t] for t in terms])
        return pd.Series(out, dtype=object)

    return stem(tokens)
