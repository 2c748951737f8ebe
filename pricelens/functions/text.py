"""Names and texts: normalised keys, slugs, tokens and rule cascades, all as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of clubs, the letters a key keeps, words that many names share.
SUFFIXES = r"(a\.?ş\.?|spor kul(ü|u)b(ü|u)|futbol|s\.?k\.?|a\.?s\.?|f\.?k\.?|f\.?c\.?|c\.?f\.?)"
KEY_LETTERS = "a-z0-9ğüşıöç "
GENERIC = ("athletic", "atletico", "borussia", "city", "club", "county", "deportivo", "istanbul", "olympique", "racing", "real", "royal", "saint", "sporting", "town", "united")
# Sanction kinds with their patterns; the first that matches wins.
SANCTIONS = (
    ("para", r"([\d.]+)\.-TL PARA CEZASI"),
    ("men", r"(\d+) RESMİ MÜSABAKADAN MEN CEZASI"),
    ("soyunma_odasi_yasagi", r"(\d+) RESMİ MÜSABAKADA SOYUNMA ODASINA"),
    ("hukmen_maglubiyet", r"\((\d+-\d+)\) HÜKMEN MAĞLUP"),
    ("ihrac", r"()İHRAÇ EDİLMESİNE"),
    ("ihtar", r"()İHTAR CEZASI"),
    ("ceza_yok", r"()CEZA TAYİNİNE YER OLMADIĞINA"),
)
#: Letters with a mark, as base and combining mark, that keys keep composed.
COMPOSED = (("g\u0306", "ğ"), ("u\u0308", "ü"), ("s\u0327", "ş"), ("o\u0308", "ö"), ("c\u0327", "ç"))
# Letters that no decomposition of Unicode takes apart, as slugs write them.
WHOLE_LETTERS = {"ß": "ss", "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ı": "i"}


def _marked_letters() -> dict[str, str]:
    """Every Latin letter that Unicode decomposes into an ASCII letter and marks, with that letter."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            out[chr(code)] = bare
    return out


_LETTERS = _marked_letters()
_MARKED, _BARE = "".join(_LETTERS), "".join(_LETTERS.values())


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def normalise_team(name: Column) -> Column:
    """Key of a club's name: Turkish lower case, composed letters, no legal suffix or punctuation, dotless i as i."""
    key = F.lower(F.trim(F.translate(name, "İI", "iı")))
    for pair, letter in COMPOSED:
        key = F.replace(key, F.lit(pair), F.lit(letter))
    key = F.regexp_replace(key, r"[a-z]\p{M}+", " ")  # the other composed letters are none of a key
    key = F.regexp_replace(key, rf"(?U)\b{SUFFIXES}\b", " ")
    key = F.regexp_replace(key, f"[^{KEY_LETTERS}]+", " ")
    return squeeze(F.translate(key, "ı", "i"))


def unmarked(text: Column) -> Column:
    """Letters without their marks, composed or combining."""
    return F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{M}+", "")


def fold(text: Column) -> Column:
    return normalise_team(unmarked(text))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens; null where nothing is left (an error to the caller)."""
    for letter, plain in WHOLE_LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    bare = F.lower(unmarked(text))
    out = F.trim(F.regexp_replace(F.regexp_replace(bare, "['’‘ʼ`]", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out != "", out)


def match_slug(home: Column, away: Column) -> Column:
    return F.concat(slug(home), F.lit("-vs-"), slug(away))


def team_tokens(name: Column) -> Column:
    """Words of four letters or more that few names share; all words if there is none."""
    words = F.array_distinct(F.filter(F.split(fold(name), " "), lambda w: w != ""))
    own = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC))
    return F.when(F.size(own) > 0, own).otherwise(words)


def sanction(text: Column) -> Column:
    """Struct (kind, amount) of the first rule that matches; kind ``other`` without one."""
    out = None
    for kind, pattern in SANCTIONS:
        amount = F.regexp_extract(text, pattern, 1)
        value = F.struct(F.lit(kind).alias("kind"), F.when(amount != "", amount).alias("amount"))
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("other").alias("kind"), F.lit(None).cast("string").alias("amount")))


def has_phrase(label: Column, phrase: str, without: tuple[str, ...] = ()) -> Column:
    """The folded label holds the whole phrase and none of the excluded words."""
    key = F.concat(F.lit(" "), fold(label), F.lit(" "))
    ok = F.contains(key, F.lit(f" {phrase} "))
    for word in without:
        ok = ok & ~F.contains(key, F.lit(f" {word} "))
    return ok
