"""Snowball stemmers for English (Porter2) and French, from the published rules."""

from __future__ import annotations

from collections.abc import Callable


def _regions(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first vowel-consonant pair from ``start`` begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _suffix(word: str, options: tuple[str, ...]) -> str:
    """The longest of ``options`` (longest first) that ends the word, or ''."""
    # most words end in none, which is one call
    if not word.endswith(options):
        return ""
    return next(s for s in options if word.endswith(s))


def _by_length(*groups: str) -> tuple[str, ...]:
    return tuple(sorted((s for g in groups for s in g.split()), key=len, reverse=True))


_EN_VOWELS = "aeiouy"
_EN_SPECIAL = dict(
    pair.split(":")
    for pair in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl "
    "sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split()
)
_EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_STEP2 = dict(
    pair.split(":")
    for pair in "ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al "
    "aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble".split()
)
_EN_STEP2_ORDER = _by_length(" ".join(_EN_STEP2), "ogi li")
_EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP3_ORDER = _by_length(" ".join(_EN_STEP3))
_EN_STEP4 = _by_length("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _en_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _EN_VOWELS and word[1] not in _EN_VOWELS
    return len(word) > 2 and word[-3] not in _EN_VOWELS and word[-2] in _EN_VOWELS and word[-1] not in _EN_VOWELS + "wxY"


def english(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    for mark in "’‘‛":
        word = word.replace(mark, "'")
    word = word.removeprefix("'")
    if "y" in word:
        letters = list(word)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in _EN_VOWELS):
                letters[i] = "Y"
        word = "".join(letters)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "") if word[:1] in "gca" else ""
    r1 = len(prefix) if prefix else _regions(word, _EN_VOWELS)
    r2 = _regions(word, _EN_VOWELS, r1)

    def has_vowel(part: str) -> bool:
        return any(c in _EN_VOWELS for c in part)

    word = word[: len(word) - len(_suffix(word, ("'s'", "'s", "'")))]
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and has_vowel(word[:-2]):
        word = word[:-1]
    if word in _EN_KEPT:
        return word

    found = _suffix(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    stem = word[: len(word) - len(found)]
    if found in ("eedly", "eed"):
        if len(stem) >= r1:
            word = stem + "ee"
    elif found and has_vowel(stem):
        word = stem
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif r1 >= len(word) and _en_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"

    found = _suffix(word, _EN_STEP2_ORDER)
    stem = word[: len(word) - len(found)]
    if found and len(stem) >= r1:
        if found == "ogi":
            word = word[:-1] if stem.endswith("l") else word
        elif found == "li":
            word = stem if stem and stem[-1] in "cdeghkmnrt" else word
        else:
            word = stem + _EN_STEP2[found]
    found = _suffix(word, _EN_STEP3_ORDER)
    stem = word[: len(word) - len(found)]
    if found and len(stem) >= (r2 if found == "ative" else r1):
        word = stem + _EN_STEP3[found]
    found = _suffix(word, _EN_STEP4)
    stem = word[: len(word) - len(found)]
    if found and len(stem) >= r2 and (found != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("l") and len(word) - 1 >= r2 and word[-2:] == "ll":
        word = word[:-1]
    elif word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _en_short(word[:-1]))):
        word = word[:-1]
    return word.replace("Y", "y")


_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_STEP1 = _by_length(
    "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences",
    "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments",
)
_FR_PLAIN = frozenset("ance iqUe isme able iste eux ances iqUes ismes ables istes".split())
_FR_STEP2A = _by_length(
    "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_2B_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_2B_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
_FR_STEP2B = _by_length("ions", _FR_2B_E, _FR_2B_A)
_FR_A = frozenset(_FR_2B_A.split())


def _fr_marked(word: str) -> str:
    """Vowel letters that act as consonants, in upper case."""
    letters = list(word)
    for i, c in enumerate(letters):
        before = letters[i - 1] if i else ""
        after = letters[i + 1] if i + 1 < len(letters) else ""
        if c == "u" and before == "q":
            letters[i] = "U"
        elif c in "ui" and before and after and before in _FR_VOWELS and after in _FR_VOWELS:
            letters[i] = c.upper()
        elif c == "y" and (before and before in _FR_VOWELS or after and after in _FR_VOWELS):
            letters[i] = "Y"
    return "".join(letters)


def _fr_rv(word: str) -> int:
    if len(word) >= 2 and (word.startswith(("par", "col", "tap")) or (word[0] in _FR_VOWELS and word[1] in _FR_VOWELS)):
        return min(3, len(word))
    return next((i + 1 for i in range(1, len(word)) if word[i] in _FR_VOWELS), len(word))


def french(word: str) -> str:
    word = _fr_marked(word.lower())
    rv = _fr_rv(word)
    r1 = _regions(word, _FR_VOWELS)
    r2 = _regions(word, _FR_VOWELS, r1)
    before = word
    verbs = False

    def cut(w: str, s: str, least: int, otherwise: str | None = None) -> str:
        """``w`` without suffix ``s`` if that lies in the region, else with another."""
        if not w.endswith(s):
            return w
        if len(w) - len(s) >= least:
            return w[: -len(s)]
        return w if otherwise is None else w[: -len(s)] + otherwise

    found = _suffix(word, _FR_STEP1)
    at = len(word) - len(found)
    stem = word[:at]
    if found in _FR_PLAIN:
        word = stem if at >= r2 else word
    elif found.startswith("at"):
        if at >= r2:
            word = cut(stem, "ic", r2, "iqU")
    elif found in ("logie", "logies"):
        word = stem + "log" if at >= r2 else word
    elif found in ("usion", "ution", "usions", "utions"):
        word = stem + "u" if at >= r2 else word
    elif found in ("ence", "ences"):
        word = stem + "ent" if at >= r2 else word
    elif found in ("ement", "ements"):
        if at >= rv:
            word = stem
            if word.endswith("iv"):
                if len(word) - 2 >= r2:
                    word = cut(word[:-2], "at", r2)
            elif word.endswith("eus"):
                if len(word) - 3 >= r2:
                    word = word[:-3]
                elif len(word) - 3 >= r1:
                    word = word[:-1] + "x"
            elif word.endswith(("abl", "iqU")):
                word = word[:-3] if len(word) - 3 >= r2 else word
            elif word.endswith(("ièr", "Ièr")):
                word = word[:-3] + "i" if len(word) - 3 >= rv else word
    elif found in ("ité", "ités"):
        if at >= r2:
            if stem.endswith("abil"):
                word = cut(stem, "abil", r2, "abl")
            elif stem.endswith("ic"):
                word = cut(stem, "ic", r2, "iqU")
            else:
                word = cut(stem, "iv", r2)
    elif found in ("if", "ive", "ifs", "ives"):
        if at >= r2:
            word = stem
            if word.endswith("at") and len(word) - 2 >= r2:
                word = cut(word[:-2], "ic", r2, "iqU")
    elif found == "eaux":
        word = word[:-1]
    elif found == "aux":
        word = stem + "al" if at >= r1 else word
    elif found in ("euse", "euses"):
        word = stem if at >= r2 else stem + "eux" if at >= r1 else word
    elif found in ("issement", "issements"):
        word = stem if at >= r1 and stem and stem[-1] not in _FR_VOWELS else word
    elif found in ("amment", "emment"):
        if at >= rv:
            word, verbs = stem + ("ant" if found[0] == "a" else "ent"), True
    elif found in ("ment", "ments"):
        if at - 1 >= rv and stem[-1] in _FR_VOWELS:
            word, verbs = stem, True

    changed = word != before
    if not changed or verbs:
        once = word
        found = next((s for s in _FR_STEP2A if word.endswith(s) and len(word) - len(s) >= rv), "")
        at = len(word) - len(found)
        if found and at - 1 >= rv and word[at - 1] not in _FR_VOWELS:
            word = word[:at]
        if word == once:
            found = next((s for s in _FR_STEP2B if word.endswith(s) and len(word) - len(s) >= rv), "")
            at = len(word) - len(found)
            if found == "ions":
                word = word[:at] if at >= r2 else word
            elif found:
                word = word[:at]
                if found in _FR_A:
                    word = cut(word, "e", rv)
        changed = changed or word != once
    if changed:
        if word.endswith("Y"):
            word = word[:-1] + "i"
        elif word.endswith("ç"):
            word = word[:-1] + "c"
    else:
        if len(word) > 1 and word[-1] == "s" and word[-2] not in "aiouès":
            word = word[:-1]
        found = next((s for s in ("ière", "Ière", "ion", "ier", "Ier", "e", "ë") if word.endswith(s) and len(word) - len(s) >= rv), "")
        at = len(word) - len(found)
        if found == "ion":
            if at >= r2 and at - 1 >= rv and word[at - 1] in "st":
                word = word[:at]
        elif found == "e":
            word = word[:at]
        elif found == "ë":
            word = word[:at] if word[:at].endswith("gu") else word
        elif found:
            word = word[:at] + "i"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    for i in range(len(word) - 1, -1, -1):
        if word[i] in _FR_VOWELS:
            if i < len(word) - 1 and word[i] in "éè":
                word = word[:i] + "e" + word[i + 1 :]
            break
    return word.lower()


def stemmer(language: str) -> Callable[[str], str]:
    try:
        return {"en": english, "fr": french}[language]
    except KeyError:
        raise ValueError(f"no stemmer for language {language!r}") from None
