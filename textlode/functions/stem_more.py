"""The Dutch and Russian Snowball stemmers and the older English one, from their published descriptions."""

from __future__ import annotations

from .stem_romance import ending, listed, regions

#: Fixed values of the Dutch description.
DUTCH_VOWELS = frozenset("aeiouyè")
DUTCH_PLAIN = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def dutch(word: str) -> str:
    word, marked = word.lower().translate(DUTCH_PLAIN), ""
    for i, c in enumerate(word):
        after = bool(marked) and marked[-1] in DUTCH_VOWELS
        before = i + 1 < len(word) and word[i + 1] in DUTCH_VOWELS
        marked += c.upper() if (c == "y" and (i == 0 or after)) or (c == "i" and after and before) else c
    word = marked
    r1, r2 = regions(word, DUTCH_VOWELS)
    r1 = max(3, r1)

    def single(word: str) -> str:
        return word[:-1] if word.endswith(("kk", "dd", "tt")) else word

    def without_en(word: str, suffix: str) -> str:
        stem = word[: -len(suffix)]
        fits = len(stem) >= r1 and stem[-1:] not in DUTCH_VOWELS and not stem.endswith("gem")
        return single(stem) if stem and fits else word

    def without_e(word: str) -> str:
        fits = word.endswith("e") and len(word) - 1 >= r1 and word[-2:-1] not in DUTCH_VOWELS
        return single(word[:-1]) if fits else word

    suffix = ending(word, listed("heden en ene s se"))
    stem = word[: len(word) - len(suffix)]
    if suffix == "heden":
        word = stem + "heid" if len(stem) >= r1 else word
    elif suffix in ("en", "ene"):
        word = without_en(word, suffix)
    elif suffix in ("s", "se") and len(stem) >= r1 and stem[-1:] not in DUTCH_VOWELS and not stem.endswith("j"):
        word = stem
    before = word
    word = without_e(word)
    lost_e = word != before
    if ending(word, ("heid",), r2) and not word.endswith("cheid"):
        word = word[:-4]
        word = without_en(word, "en") if word.endswith("en") else word
    suffix = ending(word, listed("end ing ig lijk baar bar"))
    stem = word[: len(word) - len(suffix)]
    if suffix and len(stem) >= r2:
        if suffix in ("end", "ing"):
            if ending(stem, ("ig",), r2) and not stem.endswith("eig"):
                word = stem[:-2]
            else:
                word = single(stem)
        elif suffix == "ig":
            word = word if stem.endswith("e") else stem
        elif suffix == "lijk":
            word = without_e(stem)
        elif suffix == "baar" or lost_e:
            word = stem
    if len(word) >= 4 and word[-4] not in DUTCH_VOWELS and word[-3:-1] in ("aa", "ee", "oo", "uu") and word[-1] not in DUTCH_VOWELS and word[-1] != "I":
        word = word[:-2] + word[-1]
    return word.lower()


#: Fixed values of the Russian description. Suffixes of the first groups must follow one of two vowels.
RUSSIAN_VOWELS = frozenset("аеиоуыэюя")
GERUND = listed("в вши вшись"), listed("ив ивши ившись ыв ывши ывшись")
ADJECTIVE = listed("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
PARTICIPLE = listed("ем нн вш ющ щ"), listed("ивш ывш ующ")
VERB = (
    listed("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"),
    listed("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"),
)
NOUN = listed("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def russian(word: str) -> str:
    word = word.lower().replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in RUSSIAN_VOWELS), len(word))
    r2 = regions(word, RUSSIAN_VOWELS)[1]

    def grouped(word: str, groups: tuple) -> str:
        """The word without its longest suffix of the two groups; the word itself if what it must follow is missing."""
        suffix = max((ending(word, g, rv) for g in groups), key=len)
        stem = word[: len(word) - len(suffix)]
        fits = suffix in groups[1] or ending(stem, ("а", "я"), rv)
        return stem if suffix and fits else word

    def plain(word: str, suffixes: tuple) -> str:
        return word[: len(word) - len(ending(word, suffixes, rv))]

    found = grouped(word, GERUND)
    if found == word:
        word = plain(word, ("ся", "сь"))
        found = plain(word, ADJECTIVE)
        if found != word:
            found = grouped(found, PARTICIPLE)
        else:
            found = grouped(word, VERB)
            found = plain(word, NOUN) if found == word else found
    word = plain(found, ("и",))
    word = word[: len(word) - len(ending(word, ("ость", "ост"), max(r2, rv)))]
    shorter = plain(word, ("ейше", "ейш"))
    if ending(shorter, ("нн",), rv):
        return shorter[:-1]
    return plain(shorter, ("ь",)) if shorter == word else shorter


#: Fixed values of the older English description.
PORTER_2 = dict(
    x.split(":")
    for x in """ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize
    ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log""".split()
)
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = listed("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize")


def porter(word: str) -> str:
    """The older stemmer as its author last published it."""
    word = word.lower()
    if len(word) < 3:
        return word

    def kinds(stem: str) -> str:
        """A letter for each: v for a vowel, c for a consonant; y is a vowel after a consonant."""
        out = ""
        for i, c in enumerate(stem):
            out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
        return out

    def measure(stem: str) -> int:
        return kinds(stem).count("vc")

    def short(stem: str) -> bool:
        return kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def replaced(word: str, rules: dict[str, str]) -> str:
        suffix = ending(word, listed(" ".join(rules)))
        stem = word[: len(word) - len(suffix)]
        return stem + rules[suffix] if suffix and measure(stem) > 0 else word

    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        suffix = ending(word, ("ing", "ed"))
        if suffix and "v" in kinds(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short(word):
                word += "e"
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, PORTER_2), PORTER_3)
    suffix = ending(word, PORTER_4)
    stem = word[: len(word) - len(suffix)]
    if suffix and measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
