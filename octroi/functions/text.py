"""Text and list expressions for gate names, operator lists and tariff lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


HANGUL = (0xAC00, 0xD7A3)


def _folds() -> tuple[str, str, dict[str, str], str]:
    """Characters whose compatibility decomposition, without its marks, is one other character, and those letters.

    Third: the signs that give several letters, but for Hangul syllables, which follow a rule. Fourth: a pattern of all marks.
    """
    one, several, marks = {}, {}, []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare and marks and marks[-1][1] == code - 1:
            marks[-1][1] = code
        elif not bare:
            marks.append([code, code])
        elif len(bare) == 1 and bare != c:
            one[c] = bare
        elif len(bare) > 1 and not HANGUL[0] <= code <= HANGUL[1]:
            several[c] = bare
    return "".join(one), "".join(one.values()), several, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in marks) + "]"


FOLDED, BARE, SEVERAL, MARKS = _folds()
#: One constant of pairs; no sign or letter of them is one of these two.
_PAIRS = "\x01".join(f"{sign}\x02{letters}" for sign, letters in SEVERAL.items())
_LONGER = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SEVERAL) + f"\\x{{{HANGUL[0]:x}}}-\\x{{{HANGUL[1]:x}}}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean_tokens(parts: Column) -> Column:
    trimmed = F.transform(parts, strip)
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def pipe_set(c) -> Column:
    """`"B | A|"` -> `["A", "B"]`; NULL gives an empty set."""
    return _clean_tokens(F.split(F.coalesce(_c(c), F.lit("")), r"\|"))


def route_tokens(c) -> Column:
    """Set of road names split on any of the three separators in use."""
    return _clean_tokens(F.split(F.coalesce(_c(c), F.lit("")), "[|;,]"))


def _spelled_out(c: Column) -> Column:
    """One character as the letters that it stands for; a syllable is a lead, a vowel and maybe a tail."""
    nth = F.ascii(c) - HANGUL[0]
    jamo = lambda first, n, k: F.substring(F.lit("".join(chr(first + i) for i in range(n))), k.cast("int") + 1, F.lit(1))
    tail = F.when(nth % 28 > 0, jamo(0x11A8, 27, nth % 28 - 1)).otherwise("")
    syllable = F.concat(jamo(0x1100, 19, F.floor(nth / 588)), jamo(0x1161, 21, F.floor(nth % 588 / 28)), tail)
    return F.when(nth.between(0, HANGUL[1] - HANGUL[0]), syllable).otherwise(F.coalesce(F.try_element_at(F.str_to_map(F.lit(_PAIRS), F.lit("\x01"), F.lit("\x02")), c), c))


def fold_accents(c) -> Column:
    """Letters without marks and compatibility forms as the plain characters that they stand for."""
    c = _c(c)
    out = F.translate(c, FOLDED, BARE)
    longer = F.array_join(F.transform(F.split(out, ""), _spelled_out), "")
    bare = F.regexp_replace(F.when(out.rlike(_LONGER), longer).otherwise(out), MARKS, "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), bare).otherwise(c)  # plain ASCII has nothing to fold


#: What Unicode counts as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def normalise_name(c) -> Column:
    """Accent-free upper case with single blanks: the key on which names are matched."""
    return F.trim(F.regexp_replace(F.upper(fold_accents(c)), r"(?U)\s+", " "))


def lower_bare(c) -> Column:
    """Accent-free lower case, outer white space removed."""
    return strip(F.lower(fold_accents(c)))


def decimal_comma(c) -> Column:
    """`"1 234,50"` -> 1234.5"""
    return F.regexp_replace(F.regexp_replace(_c(c), " ", ""), ",", ".").cast("double")
