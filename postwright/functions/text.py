"""Text columns: folding, cleaning, normalising, parsing of free values."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

class _Folds(dict):
    """What a character folds to: in lower case, decomposed, without marks. Filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(x for x in unicodedata.normalize("NFKD", chr(code).casefold()) if not unicodedata.combining(x))
        return out


FOLDS = _Folds()
#: So many letters are replaced one after the other, which is faster than to look up each character.
FEW_LETTERS = 64


def _single_letters() -> tuple[str, str]:
    """Characters up to the end of Latin Extended Additional that are one other character without marks, and these."""
    plain = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, range(0x80, 0x1F00))}
    pairs = [(c, p) for c, p in plain.items() if c == c.lower() and len(p) == 1 and p != c]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _single_letters()
#: Latin letters that fold to several, from the same rule.
EXPANDED = {c: FOLDS[ord(c)] for c in map(chr, [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]) if c.islower() and len(FOLDS[ord(c)]) > 1}

# What titles and company names lose.
SENIORITY = r"(?U)\b(senior|junior|sr\.?|jr\.?)\b|\((h/f|m/f/d|f/m/d|h/f/m)\)"
LEGAL_FORMS = r"(?U)\b(sarl|sas|gmbh|ltd\.?|limited|inc\.?|incorporated|bv|sa|ag|plc|llc|corp\.?|corporation)\b\.?"
BLOCK_TAGS = r"(?i)<\s*/?\s*(p|div|br|li|h[1-6]|tr|table|section|article)\b[^>]*>"

#: The commonest named entities are resolved by the JVM; only texts with another go through Python.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def required(x: Column) -> Column:
    """Trimmed; null where blank: the row has no such value and is to be rejected."""
    return optional(x)


def optional(x: Column) -> Column:
    """Trimmed, and null where blank."""
    return F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def fold(x: Column) -> Column:
    """Lower case without accents, a letter for a letter, so that offsets stay."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def full_fold(x: Column) -> Column:
    """``fold``, and Latin letters that stand for several (``ß``, ligatures) become these; offsets move."""

    def expanded(some: Column) -> Column:
        out = some
        for c, letters in EXPANDED.items():
            out = F.replace(out, F.lit(c), F.lit(letters))
        return F.when(~_ascii(some) & some.rlike("[" + "".join(EXPANDED) + "]"), out).otherwise(some)

    return once(fold(x), expanded)


def folded_with_origin(text: str) -> tuple[str, list[int] | None]:
    """The folded text and where each of its characters comes from; None where that is the same place."""
    if text.isascii():
        return text.lower(), None
    letters = {c for c in set(text) if not c.isascii()}
    if len(letters) <= FEW_LETTERS and all(x.isascii() or FOLDS[ord(x)] == x for c in letters for x in FOLDS[ord(c)]):
        folded = text.encode().lower().decode()  # A-Z alone
        for c in letters:
            folded = folded.replace(c, FOLDS[ord(c)])
    else:
        folded = text.translate(FOLDS)
    if all(len(FOLDS[ord(c)]) == 1 for c in letters):
        return folded, None
    return folded, [k for k, c in enumerate(text) for _ in FOLDS[ord(c)]]


def alias_key(x: Column) -> Column:
    """The form in which aliases are compared: trimmed, folded, blanks collapsed."""
    more = lambda some: ~_ascii(some) | reduce(lambda a, b: a | b, [some.contains(blanks) for blanks in ("  ", "\t", "\r", "\x0B", "\f")])
    collapsed = lambda some: F.when(more(some), F.regexp_replace(some, r"(?U)\s+", " ")).otherwise(some)
    return F.trim(once(F.replace(full_fold(x), F.lit("\n"), F.lit(" ")), collapsed))


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def title_key(x: Column) -> Column:
    """A title in lower case without seniority, gender notes and punctuation."""
    return _squeezed(F.regexp_replace(F.lower(x), SENIORITY, " "))


def company_key(x: Column) -> Column:
    """A company name in lower case without legal form and punctuation."""
    return _squeezed(F.regexp_replace(F.lower(x), LEGAL_FORMS, " "))


def mend_mojibake(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other texts unchanged.

    Only texts within Latin-1 are tried, and only a valid result that is shorter counts.
    """
    again = F.encode(x, "ISO-8859-1").cast("string")
    within = ~x.rlike(r"[^\x00-\xFF]") & x.rlike(r"[\x80-\xFF]")
    return F.when(within, F.when(F.is_valid_utf8(again), again).otherwise(x)).otherwise(x)


def clean(x: Column) -> Column:
    return optional(mend_mojibake(x))


@F.udf(StringType(), useArrow=False)
def _unescape_all(x: str | None) -> str | None:
    """Row by row, so that a worker holds a hundred texts and not an Arrow batch of 10,000."""
    return None if x is None else unicodedata.normalize("NFKC", html.unescape(x))


def plain_text(x: Column) -> Column:
    """HTML to text: an empty line for each block tag, a blank for other tags, entities once, one blank between words.

    Paragraphs without text vanish. Entities beyond the commonest and letters
    to be composed take one round trip through Python; texts without them never leave the JVM.
    """
    body = F.regexp_replace(F.regexp_replace(x, BLOCK_TAGS, "\n\n"), "<[^>]+>", " ")
    simple = body
    for name, char in ENTITIES.items():
        simple = F.replace(simple, F.lit(name), F.lit(char))
    rare = lambda some: some.rlike(r"&(?!lt;|gt;|quot;|#39;|apos;|nbsp;|amp;)#?\w+;") | some.rlike(r"[^\x00-ɏ]")
    # Python's answer is null for texts that have nothing rare, and for null
    text = once(F.coalesce(_unescape_all(once(body, lambda some: F.when(rare(some), some))), simple), mend_mojibake)
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def number(x: Column) -> Column:
    """A number from text, thousands commas dropped; null if it isn't one."""
    return _try_double(F.replace(x, F.lit(","), F.lit("")))


def _try_double(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(x)).cast("double")


def iso_time(x: Column) -> Column:
    """ISO date or time, Z or an offset understood, UTC if there is none; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(x), "Z$", "+00:00"))


def epoch_time(x: Column) -> Column:
    """Seconds since 1970 from text; null if they aren't a whole number."""
    return F.timestamp_seconds(F.when(x.rlike(r"^\s*-?\d{1,15}\s*$"), F.trim(x)).cast("long"))


def lookup(x: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)


def iso_country(x: Column, table: dict[str, str]) -> Column:
    """ISO code of a country name: the table first, then any two letters."""
    key = F.lower(F.trim(x))
    return F.coalesce(lookup(key, table), F.when(key.rlike(r"^\p{L}{2}$"), key))


def salary_text(x: Column) -> dict[str, Column]:
    """Bounds, currency and period of a free salary text: a sign gives the currency, one number both bounds."""
    bare = F.regexp_replace(x, r"[^\d,.\-–]", "")
    pattern = r"(\d[\d,.]*)(?:[-–](\d[\d,.]*))?"
    part = lambda k: _try_double(F.replace(F.nullif(F.regexp_extract(bare, pattern, k), F.lit("")), F.lit(","), F.lit("")))
    low, high = part(1), part(2)
    currency = F.when(x.contains("$"), "USD").when(x.contains("€"), "EUR").when(x.contains("£"), "GBP")
    return {
        "salary_min": low,
        "salary_max": F.coalesce(high, low),
        "salary_currency": currency,
        "salary_period": F.when(low.isNotNull(), "year"),
    }


def whole_salary(low: Column, high: Column, currency: Column, period: Column) -> dict[str, Column]:
    """A missing bound is the other one; currency in upper case, period in lower case."""
    return {
        "salary_min": F.coalesce(low, high),
        "salary_max": F.coalesce(high, low),
        "salary_currency": F.upper(currency),
        "salary_period": F.lower(period),
    }
