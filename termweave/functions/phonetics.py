"""Double metaphone: the primary and the alternate phonetic key of a word."""

from __future__ import annotations

_VOWELS = "AEIOUY"


class _Keys:
    def __init__(self):
        self.first: list[str] = []
        self.second: list[str] = []

    def add(self, first: str, second: str | None = None) -> None:
        self.first.append(first)
        self.second.append(first if second is None else second)


def double_metaphone(word: str, length: int = 0) -> tuple[str, str]:
    """(primary, alternate); the alternate is '' where it is the same.

    ``length`` cuts both keys; 0 leaves them whole.
    """
    w = word.upper()
    n = len(w)
    keys = _Keys()
    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w

    def at(i: int, *options: str) -> bool:
        return i >= 0 and w.startswith(options, i)

    def ch(i: int) -> str:
        return w[i] if 0 <= i < n else ""

    def vowel(i: int) -> bool:
        return bool(ch(i)) and ch(i) in _VOWELS

    i = 0
    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if ch(0) == "X":
        keys.add("S")
        i = 1
    last = n - 1
    while i < n:
        c = w[i]
        step = 2 if ch(i + 1) == c else 1
        if c in _VOWELS:
            if i == 0:
                keys.add("A")
            i += 1
        elif c == "B":
            keys.add("P")
            i += step
        elif c == "Ç":
            keys.add("S")
            i += 1
        elif c == "C":
            i += _c(w, i, at, ch, vowel, keys)
        elif c == "D":
            if at(i, "DG"):
                if ch(i + 2) and ch(i + 2) in "IEY":
                    keys.add("J")
                    i += 3
                else:
                    keys.add("TK")
                    i += 2
            else:
                keys.add("T")
                i += 2 if at(i, "DT", "DD") else 1
        elif c in "FKNQV":
            keys.add({"F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}[c])
            i += step
        elif c == "Ñ":
            keys.add("N")
            i += 1
        elif c == "G":
            i += _g(w, i, at, ch, vowel, keys, slavic)
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                keys.add("H")
                i += 2
            else:
                i += 1
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN "):
                if (i == 0 and ch(i + 4) in ("", " ")) or at(0, "SAN "):
                    keys.add("H")
                else:
                    keys.add("J", "H")
            elif i == 0:
                keys.add("J", "A")
            elif vowel(i - 1) and not slavic and ch(i + 1) in ("A", "O"):
                keys.add("J", "H")
            elif i == last:
                keys.add("J", "")
            elif not at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, "S", "K", "L"):
                keys.add("J")
            i += step
        elif c == "L":
            if step == 2:
                spanish = (i == n - 3 and at(i - 1, "ILLO", "ILLA", "ALLE")) or ((w.endswith(("AS", "OS")) or w.endswith(("A", "O"))) and at(i - 1, "ALLE"))
                keys.add("L", "" if spanish else "L")
            else:
                keys.add("L")
            i += step
        elif c == "M":
            keys.add("M")
            i += 2 if (at(i - 1, "UMB") and (i + 1 == last or at(i + 2, "ER"))) or step == 2 else 1
        elif c == "P":
            if ch(i + 1) == "H":
                keys.add("F")
                i += 2
            else:
                keys.add("P")
                i += 2 if ch(i + 1) in ("P", "B") else 1
        elif c == "R":
            if i == last and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA"):
                keys.add("", "R")
            else:
                keys.add("R")
            i += step
        elif c == "S":
            i += _s(w, i, at, ch, keys, slavic, last)
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                keys.add("X")
                i += 3
            elif at(i, "TH", "TTH"):
                if at(i + 2, "OM", "AM") or at(0, "VAN ", "VON ", "SCH"):
                    keys.add("T")
                else:
                    keys.add("0", "T")
                i += 2
            else:
                keys.add("T")
                i += 2 if ch(i + 1) in ("T", "D") else 1
        elif c == "W":
            if at(i, "WR"):
                keys.add("R")
                i += 2
            else:
                if i == 0 and (vowel(1) or at(0, "WH")):
                    keys.add("A", "F" if vowel(1) else "A")
                if (i == last and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                    keys.add("", "F")
                    i += 1
                elif at(i, "WICZ", "WITZ"):
                    keys.add("TS", "FX")
                    i += 4
                else:
                    i += 1
        elif c == "X":
            if not (i == last and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                keys.add("KS")
            i += 2 if ch(i + 1) in ("C", "X") else 1
        elif c == "Z":
            if ch(i + 1) == "H":
                keys.add("J")
                i += 2
            else:
                if at(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and ch(i - 1) != "T"):
                    keys.add("S", "TS")
                else:
                    keys.add("S")
                i += step
        else:
            i += 1
    first, second = "".join(keys.first), "".join(keys.second)
    if length:
        first, second = first[:length], second[:length]
    return first, "" if second == first else second


def _c(w, i, at, ch, vowel, keys) -> int:
    if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and ch(i + 2) != "I" and (ch(i + 2) != "E" or at(i - 2, "BACHER", "MACHER")):
        keys.add("K")
        return 2
    if i == 0 and at(i, "CAESAR"):
        keys.add("S")
        return 2
    if at(i, "CHIA"):
        keys.add("K")
        return 2
    if at(i, "CH"):
        if i > 0 and at(i, "CHAE"):
            keys.add("K", "X")
        elif i == 0 and (at(1, "HARAC", "HARIS") or (at(1, "HOR", "HYM", "HIA", "HEM") and not at(0, "CHORE"))):
            keys.add("K")
        elif (
            at(0, "VAN ", "VON ", "SCH")
            or at(i - 2, "ORCHES", "ARCHIT", "ORCHID")
            or ch(i + 2) in ("T", "S")
            or ((i == 0 or ch(i - 1) in ("A", "O", "U", "E")) and (i + 2 >= len(w) or at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ")))
        ):
            keys.add("K")
        elif i > 0:
            if at(0, "MC"):
                keys.add("K")
            else:
                keys.add("X", "K")
        else:
            keys.add("X")
        return 2
    if at(i, "CZ") and not at(i - 2, "WICZ"):
        keys.add("S", "X")
        return 2
    if at(i + 1, "CIA"):
        keys.add("X")
        return 3
    if at(i, "CC") and not (i == 1 and ch(0) == "M"):
        if ch(i + 2) in ("I", "E", "H") and not at(i + 2, "HU"):
            keys.add("KS" if (i == 1 and ch(0) == "A") or at(i - 1, "UCCEE", "UCCES") else "X")
            return 3
        keys.add("K")
        return 2
    if at(i, "CK", "CG", "CQ"):
        keys.add("K")
        return 2
    if at(i, "CI", "CE", "CY"):
        keys.add("S", "X" if at(i, "CIO", "CIE", "CIA") else "S")
        return 2
    keys.add("K")
    if at(i + 1, " C", " Q", " G"):
        return 3
    return 2 if ch(i + 1) in ("C", "K", "Q") and not at(i + 1, "CE", "CI") else 1


def _g(w, i, at, ch, vowel, keys, slavic) -> int:
    if ch(i + 1) == "H":
        if i > 0 and not vowel(i - 1):
            keys.add("K")
        elif i == 0:
            keys.add("J" if ch(2) == "I" else "K")
        elif (i > 1 and ch(i - 2) in ("B", "H", "D")) or (i > 2 and ch(i - 3) in ("B", "H", "D")) or (i > 3 and ch(i - 4) in ("B", "H")):
            pass
        elif i > 2 and ch(i - 1) == "U" and ch(i - 3) in ("C", "G", "L", "R", "T"):
            keys.add("F")
        elif ch(i - 1) != "I":
            keys.add("K")
        return 2
    if ch(i + 1) == "N":
        if i == 1 and vowel(0) and not slavic:
            keys.add("KN", "N")
        elif not at(i + 2, "EY") and ch(i + 1) != "Y" and not slavic:
            keys.add("N", "KN")
        else:
            keys.add("KN")
        return 2
    if at(i + 1, "LI") and not slavic:
        keys.add("KL", "L")
        return 2
    if i == 0 and (ch(1) == "Y" or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        keys.add("K", "J")
        return 2
    if (at(i + 1, "ER") or ch(i + 1) == "Y") and not at(0, "DANGER", "RANGER", "MANGER") and not at(i - 1, "E", "I", "RGY", "OGY"):
        keys.add("K", "J")
        return 2
    if ch(i + 1) in ("E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
        if at(0, "VAN ", "VON ", "SCH") or at(i + 1, "ET"):
            keys.add("K")
        elif at(i + 1, "IER") and i + 4 == len(w):
            keys.add("J")
        else:
            keys.add("J", "K")
        return 2
    keys.add("K")
    return 2 if ch(i + 1) == "G" else 1


def _s(w, i, at, ch, keys, slavic, last) -> int:
    if at(i - 1, "ISL", "YSL"):
        return 1
    if i == 0 and at(i, "SUGAR"):
        keys.add("X", "S")
        return 1
    if at(i, "SH"):
        keys.add("S" if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
        return 2
    if at(i, "SIO", "SIA"):
        keys.add("S", "S" if slavic else "X")
        return 3
    if (i == 0 and at(1, "M", "N", "L", "W")) or ch(i + 1) == "Z":
        keys.add("S", "X")
        return 2 if ch(i + 1) == "Z" else 1
    if at(i, "SC"):
        if ch(i + 2) == "H":
            if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                if at(i + 3, "ER", "EN"):
                    keys.add("X", "SK")
                else:
                    keys.add("SK")
            elif i == 0 and ch(3) not in ("", "W") and ch(3) not in _VOWELS:
                keys.add("X", "S")
            else:
                keys.add("X")
        elif ch(i + 2) in ("I", "E", "Y"):
            keys.add("S")
        else:
            keys.add("SK")
        return 3
    if i == last and at(i - 2, "AI", "OI"):
        keys.add("", "S")
    else:
        keys.add("S")
    return 2 if ch(i + 1) in ("S", "Z") else 1
