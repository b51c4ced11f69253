"""Text cleaning as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.words import MARKS

#: Letters without a decomposition.
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
_STROKES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T"}


@lru_cache
def _plain() -> tuple[str, str]:
    """Accented letters and what each stands for, from their decompositions."""
    table = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.decomposition(chr(c))}
    table = {k: v for k, v in table.items() if v.isascii() and v.isalpha()} | _STROKES
    return "".join(table), "".join(table.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    """A missing value reads as empty."""
    return F.coalesce(c, F.lit(""))


# Capital letters of other alphabets in the order of their code points, and what each stands for; a dot stands for itself.
_GREEK = (0x391, "A B G D E Z E Th I K L M N X O P R . S T U Ph Kh Ps O".split())
_CYRILLIC = (0x400, "Ie Io Dj Gj Ie Dz I Yi J Lj Nj Tsh Kj I U Dzh A B V G D E Zh Z I I K L M N O P R S T U F Kh Ts Ch Sh Shch ' Y ' E Iu Ia".split())
# Kana in the order of their code points, from small a.
_KANA = (
    """a a i i u u e e o o ka ga ki gi ku gu ke ge ko go sa za shi zi su zu se ze so zo ta da chi di tsu tsu du te de to do na ni nu ne no
    ha ba pa hi bi pi hu bu pu he be pe ho bo po ma mi mu me mo ya ya yu yu yo yo ra ri ru re ro wa wa wi we wo n vu ka ke""".split()
)
# Parts of Hangul syllables: beginnings, vowels, endings (the first is none).
_HANGUL = (
    "g gg n d dd r m b bb s ss - j jj c k t p h".replace("-", "").split(" "),
    "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(),
    ["", *"g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split()],
)
#: The block of Greek and Cyrillic, the kana and the syllables, by code point.
_LETTERS_FROM, _LETTERS_TO, _HIRAGANA, _KATAKANA, _SYLLABLES = 0x370, 0x52F, 0x3041, 0x30A1, 0xAC00


@lru_cache
def _block() -> list[str]:
    """What each letter of the Greek and Cyrillic blocks stands for: its own value, that of its capital, or that of the letter under its marks."""
    capitals = {chr(first + i): v for first, values in (_GREEK, _CYRILLIC) for i, v in enumerate(values) if v != "."} | {"ς": "s", "Ґ": "G"}

    def value(ch: str) -> str:
        for x in (ch, unicodedata.normalize("NFKD", ch)[0]):
            if x in capitals:
                return capitals[x]
            if x.upper() in capitals:
                return capitals[x.upper()].lower()
        return ch if unicodedata.category(ch)[0] == "L" else ""

    return [value(chr(c)) for c in range(_LETTERS_FROM, _LETTERS_TO + 1)]


def _plain_letter(ch: Column) -> Column:
    """A letter of another script in Latin letters: the table of its block, or for syllables the parts that their number gives."""
    code = F.ascii(ch)
    of = lambda values, i: F.get(F.split(F.lit("\n".join(values)), "\n"), i.cast("int"))
    syllable = code - _SYLLABLES
    start, vowels, ends = _HANGUL
    parts = (of(start, F.floor(syllable / (len(vowels) * len(ends)))), of(vowels, F.floor(syllable / len(ends)) % len(vowels)), of(ends, syllable % len(ends)))
    out = F.when(code.between(_LETTERS_FROM, _LETTERS_TO), of(_block(), code - _LETTERS_FROM)).when(code.between(_SYLLABLES, _SYLLABLES + 11171), F.concat(*parts))
    for first in (_HIRAGANA, _KATAKANA):
        out = out.when(code.between(first, first + len(_KANA) - 1), of(_KANA, code - first))
    return out.otherwise(ch)


def romanise(c: Column) -> Column:
    """Greek, Cyrillic, Hangul and kana in Latin letters; all else stays."""
    other = c.rlike("[\u0370-\u052F\u3041-\u3096\u30A1-\u30F6\uAC00-\uD7A3]")
    return F.when(other, F.array_join(F.transform(F.split(c, ""), _plain_letter), "")).otherwise(c)


def decode(c: Column) -> Column:
    """Letters of other alphabets and letters with marks as plain ASCII letters; other marks of composition go."""
    c = romanise(c)
    for k, v in _LETTERS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, *_plain()), "\\p{M}+", "")


#: Letters that LaTeX writes as commands of one letter, and the command of an accent with what it stands over.
_COMMANDS, _ACCENT = "loit", r"""\{?\\[`'^"~=.uvHtcdbkr]?\s?\{?\\?(\w*)\}?"""


def remove_accents_and_hyphens(c: Column) -> Column:
    """LaTeX accent commands leave their letters; hyphens go."""
    for k in _COMMANDS:
        c = F.replace(c, F.lit("{\\" + k + "}"), F.lit(k))
    return F.replace(F.regexp_replace(c, _ACCENT, "$1"), F.lit("-"), F.lit(""))


def remove_non_letters(c: Column) -> Column:
    """Without the marks that don't count."""
    return F.translate(c, MARKS, "")


def remove_curlies(c: Column, blanks: bool = True) -> Column:
    """Without matched braces of any depth, and without the blanks in them unless `blanks`; unmatched ones stay. Each step opens the
    innermost pairs of one reading, so there are never more steps than braces."""

    def step(s: Column, _: Column) -> Column:
        pair = F.regexp_extract(s, r"\{[^{}]*\}", 0)
        return F.when(F.contains(s, F.lit("{")) & F.contains(s, F.lit("}")), let(pair, lambda p: F.when(p == "", s).otherwise(F.replace(s, p, F.translate(p, "{}" if blanks else "{} ", ""))))).otherwise(s)

    n = F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit("")))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), c, step)).otherwise(c)


def same_words(a: Column, b: Column) -> Column:
    """Equal but for case and marks."""
    return remove_non_letters(F.lower(F.trim(a))) == remove_non_letters(F.lower(F.trim(b)))


def before_letters(c: Column, mark: str) -> Column:
    return c.rlike("^[^A-Za-z]*" + ("\\" + mark))


def after_letters(c: Column, mark: str) -> Column:
    return c.rlike("\\" + mark + "[^A-Za-z]*$")


def split_word(c: Column) -> Column:
    """Struct of what stands before the first letter, from it to the last, and after."""
    whole = r"(?s)^([^A-Za-z]*)(.*?)([^A-Za-z]*)$"
    return F.struct(*(F.regexp_extract(c, whole, i).alias(n) for i, n in enumerate(("prefix", "core", "suffix"), 1)))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2), F.length(c))))


def normalise(c: Column) -> Column:
    """For comparing titles: no brace groups, commands or marks, one blank between words, lower case."""
    c = F.regexp_replace(F.regexp_replace(text(c), r"\{[^}]*\}", ""), r"\\[a-zA-Z]+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", ""), r"(?U)\s+", " ")))


def doi(c: Column) -> Column:
    """A DOI without its resolver's address; null when empty."""
    return F.nullif(F.trim(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def same_key(a: Column, b: Column) -> Column:
    """One begins with the other; a backslash in either stands for anything."""
    return F.startswith(a, b) | F.startswith(b, a) | F.contains(a, F.lit("\\")) | F.contains(b, F.lit("\\"))


def position_of(names: Column, template: str) -> Column:
    """First place (from 0) of the words of `template` in a list of names, compared in lower case; -1 without one."""
    want = template.split(" ")
    low = F.transform(names, lambda x: F.lower(x))
    starts = F.when(F.size(names) >= len(want), F.sequence(F.lit(0), F.size(names) - len(want))).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.slice(low, i + 1, len(want)) == F.array(*map(F.lit, want)))
    return F.coalesce(F.get(found, 0), F.lit(-1))
