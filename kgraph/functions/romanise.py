"""Romanisation of Devanagari, Telugu and Urdu script, as column functions.

A sign's Latin form depends on itself and the one or two signs after it, so each script is one `transform` over
characters. Only the Urdu doubling mark looks back; it is expanded beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgraph.functions.scalars import bind

# fixed values: Latin forms of each script's signs ------------------------------------------------------------------
DEVANAGARI_VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri"}
DEVANAGARI_MATRAS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri"}
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
DEVANAGARI_NUKTA = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f"}
DEVANAGARI_OTHER = {"ं": "n", "ँ": "n", "ः": "h", "्": "", "़": "", "।": ".", "॥": "."} | {chr(0x966 + i): str(i) for i in range(10)}
TELUGU_VOWELS = {"అ": "a", "ఆ": "aa", "ఇ": "i", "ఈ": "ee", "ఉ": "u", "ఊ": "oo", "ఋ": "ru", "ఎ": "e", "ఏ": "ee", "ఐ": "ai", "ఒ": "o", "ఓ": "oo", "ఔ": "au"}
TELUGU_MATRAS = {"ా": "aa", "ి": "i", "ీ": "ee", "ు": "u", "ూ": "oo", "ృ": "ru", "ె": "e", "ే": "ee", "ై": "ai", "ొ": "o", "ో": "oo", "ౌ": "au"}
TELUGU_CONSONANTS = {
    "క": "k", "ఖ": "kh", "గ": "g", "ఘ": "gh", "ఙ": "ng", "చ": "ch", "ఛ": "chh", "జ": "j", "ఝ": "jh", "ఞ": "ny",
    "ట": "t", "ఠ": "th", "డ": "d", "ఢ": "dh", "ణ": "n", "త": "t", "థ": "th", "ద": "d", "ధ": "dh", "న": "n",
    "ప": "p", "ఫ": "ph", "బ": "b", "భ": "bh", "మ": "m", "య": "y", "ర": "r", "ఱ": "rr", "ల": "l", "ళ": "l", "వ": "v",
    "శ": "sh", "ష": "sh", "స": "s", "హ": "h",
}
TELUGU_OTHER = {"ం": "n", "ః": "h", "ఁ": "n", "్": ""} | {chr(0xC66 + i): str(i) for i in range(10)}
URDU = {
    "آ": "aa", "ا": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh",
    "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "r", "ز": "z", "ژ": "zh", "س": "s", "ش": "sh", "ص": "s", "ض": "z",
    "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ک": "k", "گ": "g", "ل": "l", "م": "m",
    "ن": "n", "ں": "n", "و": "o", "ہ": "h", "ۃ": "h", "ھ": "h", "ه": "h", "ی": "i", "ي": "y", "ے": "e", "ئ": "",
    "ء": "", "أ": "a", "إ": "i", "ؤ": "o", "ٰ": "a", "َ": "a", "ِ": "i", "ُ": "u", "ً": "an",
    "ٍ": "in", "ٌ": "un", "؟": "?", "،": ",", "؛": ";", "۔": ".",
} | {chr(0x6F0 + i): str(i) for i in range(10)} | {chr(0x660 + i): str(i) for i in range(10)}
# --------------------------------------------------------------------------------------------------------------------
VIRAMA, NUKTA, TELUGU_VIRAMA, SHADDA = "्", "़", "్", "ّ"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _in(c: Column, chars) -> Column:
    return F.coalesce(c.isin(list(chars)), F.lit(False))


def _walk(text: Column, form) -> Column:
    """Join form(character, next, next but one) over the text."""
    return bind(F.split(text, ""), lambda cs: F.array_join(F.transform(cs, lambda c, i: form(c, F.get(cs, i + 1), F.get(cs, i + 2))), ""))


def devanagari(text: Column) -> Column:
    base, nukta = _map(DEVANAGARI_CONSONANTS), _map(DEVANAGARI_NUKTA)
    rest = _map(DEVANAGARI_VOWELS | DEVANAGARI_MATRAS | DEVANAGARI_OTHER)
    silent = {VIRAMA, *DEVANAGARI_MATRAS}

    def form(c, n, m):
        dotted = _in(n, [NUKTA])
        vowel = lambda x: F.when(_in(x, silent), "").otherwise("a")
        latin = F.when(dotted, F.concat(F.coalesce(F.element_at(nukta, c), F.element_at(base, c)), vowel(m))).otherwise(F.concat(F.element_at(base, c), vowel(n)))
        return F.when(_in(c, DEVANAGARI_CONSONANTS), latin).otherwise(F.coalesce(F.element_at(rest, c), c))

    return _walk(text, form)


def telugu(text: Column) -> Column:
    base, rest = _map(TELUGU_CONSONANTS), _map(TELUGU_VOWELS | TELUGU_MATRAS | TELUGU_OTHER)
    silent = {TELUGU_VIRAMA, *TELUGU_MATRAS}

    def form(c, n, _):
        latin = F.concat(F.element_at(base, c), F.when(_in(n, silent), "").otherwise("a"))
        unknown = F.when(c.rlike(r"[\x{0C00}-\x{0C7F}]"), "").otherwise(c)
        return F.when(_in(c, TELUGU_CONSONANTS), latin).otherwise(F.coalesce(F.element_at(rest, c), unknown))

    return _walk(text, form)


def urdu(text: Column) -> Column:
    """Each doubling mark repeats the sign before it; marks without a sign are dropped."""
    mapped = "".join(URDU)
    unread = rf"[[\x{{0600}}-\x{{06FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]&&[^{mapped}{SHADDA}]]"
    runs = F.regexp_extract_all(F.regexp_replace(text, unread, ""), F.lit(f"(?s)[^{SHADDA}]{SHADDA}*"), F.lit(0))
    out = F.array_join(F.transform(runs, lambda r: F.repeat(F.left(r, F.lit(1)), F.length(r))), "")
    table = _map(URDU)
    return _walk(out, lambda c, n, m: F.coalesce(F.element_at(table, c), c))


def _where(text: Column, pattern: str, step) -> Column:
    return bind(text, lambda t: F.when(t.rlike(pattern), step(t)).otherwise(t))


def romanise(text: Column) -> Column:
    """Urdu, then Telugu, then Devanagari; text without these scripts passes through."""
    for pattern, step in ((r"[\x{0600}-\x{06FF}]", urdu), (r"[\x{0C00}-\x{0C7F}]", telugu), (r"[\x{0900}-\x{097F}]", devanagari)):
        text = _where(text, pattern, step)
    return text
