"""Column expressions for name normalisation.

All functions take and return ``Column`` objects built from JVM-side
built-ins, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- accent folding -------------------------------------------------------
# NFD followed by dropping non-spacing marks, built from a rule: every
# character whose NFD form minus marks is a single different character
# is folded with ``translate``; combining marks already present are then
# deleted.


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for ch in map(chr, range(0x80, 0x110000)):
        if not unicodedata.decomposition(ch) or "\uf900" <= ch <= "\ufaff" or ch >= "\U0002f800":
            continue  # nothing to decompose, or an ideograph's other form
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _fold_table()

# Punctuation deleted by canonicalisation (deleted, not
# replaced by a space), in the order the behaviour is specified.
PUNCTUATION = "‘’“”'\"!?;/⧸⁄‹›«»`ʿ,.-"
PUNCT_REGEX = "[" + PUNCTUATION.replace("\\", "\\\\").replace("-", "\\-") \
    .replace("[", "\\[").replace("]", "\\]") + "]"

# ASCII transliteration of Latin letters that have no
# canonical decomposition (small subset of a full transliteration).
TRANSLIT = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"),
            ("ł", "l"), ("þ", "th"), ("ð", "d"), ("ı", "i")]

SORT_THRESHOLD = 0.55  # fixed value: alignment switch for the custom sort


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(s) -> Column:
    """B1: NFD + drop category Mn."""
    return F.regexp_replace(F.translate(c(s), FOLD_SRC, FOLD_DST), r"\p{Mn}", "")


def transliterate(s) -> Column:
    out = c(s)
    for a, b in TRANSLIT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(s) -> Column:
    """B2: lower -> accent strip -> transliteration -> delete punctuation."""
    return F.regexp_replace(transliterate(strip_accents(F.lower(c(s)))), PUNCT_REGEX, "")


def split_space(s) -> Column:
    """``str.split(' ')``: single-space split keeping empty tokens."""
    return F.split(c(s), " ", -1)


def split_ws(s) -> Column:
    """``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(c(s), r"\s+", -1), lambda t: t != F.lit(""))


def natural_key(tok: Column) -> Column:
    """B5 key: alternating text / number segments; a number is its count of
    digits without leading zeros, then these, so that string order equals
    integer order at any length; a leading empty text segment when the
    token starts with a digit keeps segment kinds aligned."""
    def number(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    segs = F.regexp_extract_all(tok, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    segs = F.transform(segs, lambda x: F.when(x.rlike(r"^[0-9]+$"), number(x))
                       .otherwise(x))
    return F.when(tok.rlike(r"^[0-9]"), F.concat(F.array(F.lit("")), segs)).otherwise(segs)


def natural_sort(arr) -> Column:
    """Stable natural sort of an array of tokens."""
    keyed = F.transform(c(arr), lambda t, i: F.struct(natural_key(t).alias("k"),
                                                      i.alias("p"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def simple_sort(s) -> Column:
    """Natural-sort the space-split tokens and join them again."""
    return F.array_join(natural_sort(split_space(s)), " ")


def plain_sorted(s) -> Column:
    """Code-point sort of the space-split tokens (used by sorted JW)."""
    return F.array_join(F.array_sort(split_space(s)), " ")


def reverse(s) -> Column:
    """B6."""
    return F.reverse(c(s))


def no_space(s) -> Column:
    return F.replace(c(s), F.lit(" "), F.lit(""))


# --- alphabets (B9, B10) --------------------------------------------------
# Scripts tested first, in priority order (Cyrillic first).
SCRIPTS = ["CYRILLIC", "LATIN", "GREEK", "ARABIC", "HEBREW", "ARMENIAN", "GEORGIAN",
           "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "BENGALI", "GURMUKHI",
           "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "LAO", "TIBETAN",
           "MYANMAR", "ETHIOPIC", "CHEROKEE", "OGHAM", "RUNIC", "TAGALOG", "KHMER", "MONGOLIAN", "BOPOMOFO",
           "YI", "SYRIAC", "THAANA", "NKO", "COPTIC", "GOTHIC", "TIFINAGH", "GLAGOLITIC", "JAVANESE", "BALINESE"]
_SCRIPT_CLASS = {s: r"\p{Is" + ("Han" if s == "CJK" else s.capitalize()) + "}" for s in SCRIPTS}


def _named_classes() -> dict[str, str]:
    """Letters of no script above, by the first word of their Unicode names:
    word -> character class, in order of the word's first letter."""
    spans: dict[str, list[list[int]]] = {}
    for cp in range(0x80, 0x110000):
        if chr(cp).isalpha():
            word = unicodedata.name(chr(cp), "").split(" ")[0]
            mine = spans.setdefault(word, [])
            if mine and mine[-1][1] == cp - 1:
                mine[-1][1] = cp
            else:
                mine.append([cp, cp])
    return {w: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in r) + "]" for w, r in spans.items() if w and w not in SCRIPTS}


NAMED = _named_classes()


def detect_alphabet(s) -> Column:
    """CYRILLIC wins, else the first script present, else the first word
    of a letter's Unicode name (for letters of rarer scripts), else UND."""
    expr = None
    for name in SCRIPTS:
        cond = c(s).rlike(r"(?=\p{L})" + _SCRIPT_CLASS[name])
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    # one constant array; only texts without a letter of the scripts above, and beyond ASCII, look at it
    rare = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("letters")) for w, k in NAMED.items()])
    found = F.get(F.filter(rare, lambda x: F.rlike(c(s), x["letters"])), F.lit(0))["word"]
    return expr.when(c(s).rlike(r"[^\x00-\x7F]"), F.coalesce(found, F.lit("UND"))).otherwise(F.lit("UND"))


def _letters_of(alphabet: str) -> str:
    name = alphabet.upper()
    return _SCRIPT_CLASS[name] if name in _SCRIPT_CLASS else NAMED[name]


def only_alphabet(s, alphabet: str) -> Column:
    """B10 (only=True): every letter belongs to ``alphabet``."""
    cls = _letters_of(alphabet)
    return ~c(s).rlike(r"[\p{L}&&[^" + cls + "]]")


def any_alphabet(s, alphabet: str) -> Column:
    """B10 (only=False): some letter belongs to ``alphabet``."""
    return c(s).rlike(r"(?=\p{L})" + _letters_of(alphabet))
