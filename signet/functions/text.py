"""Names, identifiers, dates and amounts as Column expressions; nulls give null unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(char: str) -> str:
    """A character's compatibility form in lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()


def _folds() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII letter or digit with marks, and that letter; by rule, not by list."""
    pairs = {chr(code): base for code in (*range(0x80, 0x3000), *range(0xFF10, 0xFF5B)) if len(base := _plain(chr(code))) == 1 and base.isascii() and base.isalnum()}
    return "".join([*pairs, "ı"]), "".join([*pairs.values(), "i"])


def _wide() -> dict[str, str]:
    """Ligatures and fractions whose compatibility form is several ASCII letters or digits, and that form."""
    forms = {chr(code): "".join(c if c.isascii() and c.isalnum() else " " for c in _plain(chr(code))) for code in (*range(0x80, 0x250), *range(0xFB00, 0xFB07))}
    return {char: form for char, form in forms.items() if len(form.strip()) > 1}


FROM, TO = _folds()
WIDE = _wide()
#: Legal forms in normalised text, of two words and of one.
LEGAL_PAIRS = ["limited sirketi", "anonim sirketi", "kollektif sirketi", "komandit sirketi", "ltd sti", "a s"]
LEGAL_WORDS = ["limited", "anonim", "sirketi", "sirket", "ltd", "sti", "as"]
#: Months in normalised text.
MONTHS = ["ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik"]
#: Letters of the Turkish alphabet that have marks, and those of older spellings.
MARKED = "çğöşüâîûÇĞÖŞÜÂÎÛİ"
#: Phrases in normalised text that say that a right has no end, and that a rule excludes what it names.
INDEFINITE = ["aksi karar alinincaya kadar", "suresiz", "belirsiz sureli"]
BLOCKING = ["kapsam disi", "yetkili degildir", "yetki disinda", "ayrica karar aranir"]


def composed(text: Column) -> Column:
    """Letters and their combining marks as one letter each, for the Turkish alphabet."""
    for letter in MARKED:
        text = F.replace(text, F.lit(unicodedata.normalize("NFD", letter)), F.lit(letter))
    return text


def tr_lower(text: Column) -> Column:
    return F.lower(F.translate(composed(text), "Iİ", "ıi"))


def tr_upper(text: Column) -> Column:
    return F.upper(F.translate(composed(text), "iı", "İI"))


def spelled_out(text: Column) -> Column:
    """Ligatures and fractions as the letters they stand for."""
    out = text
    for char, form in WIDE.items():
        out = F.replace(out, F.lit(char), F.lit(form))
    return F.when(text.rlike(f"[{''.join(WIDE)}]"), out).otherwise(text)


#: Lower-case letters that Turkish texts have beside ASCII, those without marks, and those in upper case that aren't ASCII.
USUAL, USUAL_PLAIN, USUAL_UPPER = "çğıöşüâîû", "cgiosuaiu", "ÇĞİÖŞÜÂÎÛ"


def _replaced(text: Column, letters: str, others: str) -> Column:
    """Letter by letter, each a search over bytes: for a few letters faster than a look-up for every letter of the text."""
    for letter, other in zip(letters, others, strict=True):
        text = F.replace(text, F.lit(letter), F.lit(other))
    return text


def tr_normalize(text: Column) -> Column:
    """Lower case by Turkish rules, without marks, runs of anything but ASCII letters and digits as one space.

    Texts of ASCII and the usual letters, nearly all, never meet the map of all folds;
    which they are is asked of the text itself, so nothing is replaced twice, and ASCII
    is ruled out by one comparison before any letter is looked for.
    """
    lower = F.lower(_replaced(F.replace(text, F.lit("I\u0307"), F.lit("i")), "Iİ", "ıi"))
    folded = F.translate(F.regexp_replace(spelled_out(lower), r"\p{M}+", ""), FROM, TO)
    usual = _replaced(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), USUAL, USUAL_PLAIN)
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).when(text.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[^{USUAL}{USUAL_UPPER}]]"), folded).otherwise(usual)
    return F.trim(F.regexp_replace(plain, "[^0-9a-z]+", " "))


def normalize_name(text: Column) -> Column:
    """Another key, for registries: letters of the Turkish alphabet stay as they are, and what isn't one is a space."""
    wide = F.translate(F.translate(text, "Iİ", "ıi"), "".join(chr(c) for c in range(0xFF10, 0xFF5B)), "".join(unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF10, 0xFF5B)))
    return F.trim(F.regexp_replace(composed(spelled_out(F.lower(wide))), "[^a-z0-9çğıöşü]+", " "))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def name_equal(a: Column, b: Column) -> Column:
    """False if either is missing or has no letters; never fuzzy."""
    x, y = tr_normalize(a), tr_normalize(b)
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def company_core(name: Column) -> Column:
    """A company's name without its legal forms, the longest first and never to nothing; ``san [ve] tic`` is written out."""
    plain, pair, any_ = tr_normalize(name), "|".join(LEGAL_PAIRS), "|".join(LEGAL_PAIRS + LEGAL_WORDS)
    only = F.regexp_extract(plain, f"^({pair})( ({any_}))*$", 1)
    bare = F.when(only != "", only).otherwise(F.regexp_replace(plain, f"(?<=[0-9a-z])( ({any_}))+$", ""))
    return F.regexp_replace(bare, r"\bsan( ve)? tic\b", "sanayi$1 ticaret")


def company_equal(a: Column, b: Column) -> Column:
    x, y = company_core(a), company_core(b)
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def masked_id(text: Column) -> Column:
    """``ddd******dd`` for a masked identifier of any number of stars, null for anything else."""
    parts = F.regexp_extract(F.trim(text), r"^([0-9]{3})\*+[0-9]{2}$", 1), F.regexp_extract(F.trim(text), r"^[0-9]{3}\*+([0-9]{2})$", 1)
    return F.when(parts[0] != "", F.concat(parts[0], F.lit("******"), parts[1]))


def masked_equal(a: Column, b: Column) -> Column:
    return F.coalesce(masked_id(a) == masked_id(b), F.lit(False))


def _digit(text: Column, i: int) -> Column:
    return F.substring(text, i, 1).cast("int")


def valid_tckn(text: Column) -> Column:
    """The checksum of an 11-digit personal identifier."""
    d = [_digit(text, i) for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    return F.when(~text.rlike("^[1-9][0-9]{10}$"), False).otherwise((F.pmod(7 * odd - even, F.lit(10)) == d[9]) & ((odd + even + d[9]) % 10 == d[10]))


def valid_vkn(text: Column) -> Column:
    """The checksum of a 10-digit tax number."""
    total = F.lit(0)
    for i in range(1, 10):
        moved = (_digit(text, i) + 10 - i) % 10
        part = (moved * (1 << (10 - i))) % 9
        total = total + F.when((moved != 0) & (part == 0), 9).otherwise(part)
    return F.when(~text.rlike("^[0-9]{10}$"), False).otherwise((10 - total % 10) % 10 == _digit(text, 10))


def parse_date(text: Column) -> Column:
    """ISO, day first with . / or -, or day, Turkish month name and year; null for anything else or an impossible day."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", 1)
    day_first = F.regexp_replace(F.regexp_extract(t, r"^([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})$", 1), "[./]", "-")
    words = F.split(tr_normalize(t), " ")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(words, 1))
    named = F.when((F.size(words) == 3) & (month > 0) & F.get(words, 0).rlike("^[0-9]{1,2}$") & F.get(words, 2).rlike("^[0-9]{4}$"), F.concat_ws("-", F.get(words, 2), month.cast("string"), F.get(words, 0)))
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "y-M-d"), F.try_to_date(F.nullif(day_first, F.lit("")), "d-M-y"), F.try_to_date(named, "y-M-d"))


def format_amount(minor: Column) -> Column:
    """Minor units as ``1.234,56 TL``."""
    whole = F.translate(F.format_number(F.floor(minor / 100), 0), ",", ".")
    return F.concat(whole, F.lit(","), F.lpad((minor % 100).cast("string"), 2, "0"), F.lit(" TL"))


def redact(text: Column, longest: int = 500) -> Column:
    """Bare runs of 11 digits are masked, and what is left is cut at ``longest`` characters."""
    t = F.regexp_replace(text, r"(?<![0-9])[0-9]{11}(?![0-9])", "[REDACTED_TCKN]")
    return F.when(F.length(t) > longest, F.concat(F.left(t, F.lit(longest)), F.lit("…[truncated]"))).otherwise(t)


# Words that say nothing in a group's name, and the names of ranks.
GROUP_NOISE = ["grup", "grubu", "derece", "derecesi", "imza", "yetkili", "yetkilisi", "yetkilileri"]
GROUP_RANKS = {"birinci": "1", "ikinci": "2", "ucuncu": "3", "dorduncu": "4", "besinci": "5", "altinci": "6", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}


def group_code(text: Column) -> Column:
    """A group's name without noise words; a rank that stands alone becomes its number; empty if nothing is left."""
    return plain_code(tr_normalize(text))


def plain_code(plain: Column) -> Column:
    """``group_code`` of a text that is normalised already; no lambda, so all of it is compiled."""
    kept = F.ltrim(F.regexp_replace(F.coalesce(plain, F.lit("")), f"(^| )({'|'.join(GROUP_NOISE)})(?= |$)", ""))
    rank = F.create_map(*(F.lit(x) for pair in GROUP_RANKS.items() for x in pair))
    return F.coalesce(F.try_element_at(rank, kept), kept)


def dates_in(quote: Column) -> Column:
    """All possible day-first dates in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit(r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b"), F.lit(0))
    return F.filter(F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, "[./]", "-"), "d-M-y")), lambda d: d.isNotNull())


def says_indefinite(quote: Column) -> Column:
    return F.coalesce(tr_normalize(quote).rlike("|".join(INDEFINITE)), F.lit(False))


def says_blocked(scope: Column, quote: Column) -> Column:
    return tr_normalize(F.concat_ws(" ", scope, quote)).rlike("|".join(BLOCKING))


def _unbroken(pages: Column) -> Column:
    return F.element_at(pages, -1) - F.element_at(pages, 1) == F.size(pages) - 1


def page_list(pages: Column, between: str = ", ") -> Column:
    """Ascending pages as ``3``, ``3-5`` or, where some are missing, one by one."""
    ends = F.concat_ws("-", F.element_at(pages, 1).cast("string"), F.element_at(pages, -1).cast("string"))
    return F.when(F.size(pages) == 1, F.element_at(pages, 1).cast("string")).when(_unbroken(pages), ends).otherwise(F.array_join(F.transform(pages, lambda p: p.cast("string")), between))


def page_span(pages: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(F.array(F.array_min(pages), F.array_max(pages)), lambda p: p.cast("string"))), "-")


def chunk_pages(chunk_id: Column) -> Column:
    """The pages that a chunk's name ends with: the inverse of ``page_list`` with ``+``; none if there are no such."""
    token = F.regexp_extract(F.coalesce(chunk_id, F.lit("")), "^.*_p(.*)$", 1)
    low, high = (F.regexp_extract(token, "^([0-9]+)-([0-9]+)$", k).try_cast("int") for k in (1, 2))
    none = F.array().cast("array<int>")
    listed = F.when(token.rlike(r"^[0-9]+(\+[0-9]+)*$"), F.split(token, "[+]").cast("array<int>"))
    return F.coalesce(listed, F.when(low <= high, F.sequence(low, high)), none)


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen; ``unknown`` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))


def parse_amount(text: Column) -> Column:
    """Minor units of ``1.234,5 TL``, by digits alone; null for anything else and beyond 2 ** 53 - 1."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s|₺", ""), "(?i)TL$", ""), "[.]", "")
    whole, part = (F.regexp_extract(bare, "^([0-9]+)(?:,([0-9]{1,2}))?$", k) for k in (1, 2))
    minor = F.concat(whole, F.rpad(part, 2, "0")).try_cast("decimal(38,0)")
    return F.when((whole != "") & (minor <= F.lit((1 << 53) - 1)), minor.cast("long"))


def amount_range(low: Column, high: Column) -> Column:
    """The words around one or two amounts; a missing one is open."""
    return (
        F.when(low.isNull() & high.isNull(), "Tutar sınırı yok").when(low.isNull(), F.concat(format_amount(high), F.lit(" ve altı")))
        .when(high.isNull(), F.concat(format_amount(low), F.lit(" ve üzeri"))).otherwise(F.concat_ws(" – ", format_amount(low), format_amount(high)))
    )


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1 << 20), 1).cast("decimal(20,1)").cast("string"), F.lit(" MB")))


def instant(at: Column) -> Column:
    """A UTC instant to the second, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def without_fence(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")


#: The prefix and the letters of an authorisation code.
CODE_PREFIX, CODE_LETTERS = "YTK-", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def authorization_code(*parts: Column) -> Column:
    """Eight letters from a digest of ``parts``: reruns agree, and equal codes show up as a repeated key."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    letters = (F.substring(F.lit(CODE_LETTERS), F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 32 + 1, F.lit(1)) for i in range(8))
    return F.concat(F.lit(CODE_PREFIX), *letters)


def display_name(name: Column, kind: Column) -> Column:
    """A file's name without folders and control characters, of at most 255; ``belge`` with its kind if nothing is left."""
    last = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^\\/]*)$", 1), r"[\x00-\x1f\x7f]", ""))
    return F.left(F.coalesce(F.nullif(last, F.lit("")), F.concat(F.lit("belge"), kind)), F.lit(255))
