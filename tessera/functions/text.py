"""Names and addresses in normal form, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The linkage rules' word lists and patterns.
ABBREVIATIONS = {
    "intl": "international", "mfg": "manufacturing", "tech": "technology", "svcs": "services", "svc": "service",
    "mgmt": "management", "dept": "department", "natl": "national", "assn": "association", "assoc": "associates",
    "grp": "group", "hldgs": "holdings", "engg": "engineering", "engr": "engineering", "govt": "government",
    "indl": "industrial", "sys": "systems", "soln": "solutions", "solns": "solutions", "telecom": "telecommunications",
    "pharma": "pharmaceuticals", "hosp": "hospital", "univ": "university", "edu": "education", "fin": "financial",
    "mktg": "marketing", "acct": "accounting", "ins": "insurance", "med": "medical", "infra": "infrastructure",
    "const": "construction", "prop": "properties", "dev": "development",
}
STREETS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "dr": "drive",
    "pkwy": "parkway", "ln": "lane", "ct": "court", "cir": "circle", "hwy": "highway", "ste": "unit", "apt": "unit",
    "fl": "floor", "bldg": "building", "str": "street", "sq": "square", "pl": "place",
}
COMMON_STREET_WORDS = (
    "road", "street", "avenue", "boulevard", "drive", "lane", "place", "court", "circle", "highway", "way", "floor",
    "unit", "building", "suite", "apt", "east", "west", "north", "south", "nagar", "marg", "gali", "colony", "cross",
    "main", "near", "opp", "opposite", "behind", "dist", "taluk", "phase", "sector",
)
SUFFIXES = {
    "US": "inc|incorporated|corp|corporation|llc|l l c|ltd|limited|lp|llp|pllc|co",
    "India": "pvt|private|ltd|limited|llp",
    "France": "sarl|s a r l|sas|s a s|sasu|sa|s a|sci|eurl|snc|ets|etablissements",
}
ALL_SUFFIXES = "|".join([SUFFIXES["US"], "pvt|private", SUFFIXES["France"]])
DOMAINS = r"\.(com|org|net|co|in|io|biz|us|fr|edu|gov)\b"
# Digits are those of any script.
POSTAL_6, POSTAL_5, NUMBER = r"(?U)\b\d{6}\b", r"(?U)\b\d{5}\b", r"(?U)\b\d+[a-zA-Z]?\b"

#: Letters that don't decompose into a base letter and marks.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}


def _latin() -> tuple[str, str]:
    """Accented Latin letters and full-width forms with their ASCII characters, from Unicode's own decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isprintable():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN_FROM, LATIN_TO = _latin()


def latin_to_ascii(c: Column) -> Column:
    """Latin letters without accents; all else stays."""
    single = {a: b for a, b in LIGATURES.items() if len(b) == 1}
    out = F.translate(c, LATIN_FROM + "".join(single), LATIN_TO + "".join(single.values()))
    for a, b in LIGATURES.items():
        if a not in single:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    """Any script to ASCII, letter by letter from the letters' Unicode names. Only for text that needs it."""

    def one(ch: str) -> str:
        if ch.isascii():
            return ch
        flat = unicodedata.normalize("NFKD", ch)
        kept = "".join(x for x in flat if x.isascii())
        if kept:
            return kept
        if unicodedata.decimal(ch, None) is not None:
            return str(unicodedata.decimal(ch))
        name = unicodedata.name(ch, "")
        for mark in (" LETTER ", " VOWEL SIGN "):
            if mark in name:
                sound = name.partition(mark)[2].partition(" WITH ")[0].split()[-1].lower()
                script = name.split()[0]
                if script == "CYRILLIC" and len(sound) > 1:  # a consonant's name has a vowel before or after it
                    return sound[1:] if sound[0] == "i" else sound.strip("aeiou") + ("" if sound.strip("aeiou") not in ("y", "") else sound[-1])
                if script == "GREEK":
                    return sound[: 2 if sound[1:2] in ("h", "s") else 1]
                return sound
        return ""

    return texts.map(lambda t: None if t is None else "".join(map(one, unicodedata.normalize("NFKC", t))))


def to_ascii(c: Column) -> Column:
    """Latin letters without accents in the JVM; only text that has other scripts or loose marks goes through transliterate()."""
    other = c.rlike(r"[^\x00-\x7F" + LATIN_FROM + "".join(LIGATURES) + "]")
    return F.when(other, transliterate(F.when(other, c))).otherwise(latin_to_ascii(c))


def words(c: Column) -> Column:
    """The space-separated words of a normal form; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(words(c), lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")


def clean_text(c: Column, ascii_only: bool = True) -> Column:
    """Lower case, ASCII letters, no domains, handles or punctuation, abbreviations spelled out; null is empty."""
    out = F.lower(to_ascii(F.coalesce(c, F.lit("")))) if ascii_only else F.lower(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(out, DOMAINS, "")
    out = F.regexp_replace(out, "^[#@]+", "")
    out = F.replace(F.replace(out, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    out = F.translate(out, "/-", "  ")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return _mapped(out, ABBREVIATIONS)


def core_name(name: Column, country: Column) -> Column:
    """A cleaned name without up to three legal suffixes of its country; never empty unless the name is."""
    # The country is put before the name, so that suffixes of all countries are one pattern and each step names its input once.
    own = "|".join(rf"{k}\x00.*?\b(?=(?:{v})\s*$)" for k, v in [*SUFFIXES.items(), ("", ALL_SUFFIXES)])
    mark = F.concat(F.when(country.isin(*SUFFIXES), country).otherwise(""), F.lit("\x00"))

    def strip(c: Column) -> Column:
        out = F.regexp_replace(F.concat(mark, c), rf"(?s)^({own}).*$", "$1")
        return F.trim(F.regexp_replace(out, r"(?s)^[^\x00]*\x00", ""))

    core = strip(strip(strip(name)))
    return F.when(core == "", name).otherwise(core)


def name_tokens(c: Column, least: int = 2) -> Column:
    """Distinct words of a normal form, sorted; not those that are short or all digits."""
    return F.array_sort(F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$"))))


def clean_address(c: Column) -> Column:
    return _mapped(clean_text(c), STREETS)


def postal_code(addr: Column, country: Column | None = None) -> Column:
    """The first postal code in its country's form; six digits, then five, where the country is another or unknown."""
    addr = F.coalesce(addr, F.lit(""))
    six, five = (F.regexp_extract(addr, p, 0) for p in (POSTAL_6, POSTAL_5))
    either = F.when(six != "", six).otherwise(five)
    if country is None:
        return either
    return F.when(country == "India", six).when(country.isin("US", "France"), five).otherwise(either)


def _stripped(w: Column) -> Column:
    bare = F.regexp_replace(w, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def numbers(addr: Column, postal: Column) -> Column:
    """Distinct numbers as written and without leading zeros, sorted, the postal code left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(addr, F.lit(""))), F.lit(NUMBER), F.lit(0))
    both = F.concat(found, F.transform(found, _stripped))
    return F.array_sort(F.array_distinct(F.filter(both, lambda w: (postal == "") | ((w != postal) & (w != _stripped(postal))))))


def trigrams(c: Column) -> Column:
    """Distinct character trigrams, sorted; a shorter text is its own only gram."""
    grams = F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))
    return F.array_sort(F.array_distinct(grams.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))))


def street_words(addr: Column) -> Column:
    """An address's telling words in order, repeats included."""
    common = F.array(*[F.lit(w) for w in COMMON_STREET_WORDS])
    return F.filter(words(addr), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~F.array_contains(common, w))
