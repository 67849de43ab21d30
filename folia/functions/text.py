"""Text functions as Column builders: folding, value keys, numbers in either locale, keys and estimates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_tables() -> tuple[str, str]:
    """Every letter that decomposes to one base character and marks, and its base; d with stroke beside them."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_SRC, _DST = _fold_tables()


def unaccent(c: Column) -> Column:
    """Lower case without diacritics; a text of one byte a character has none."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.regexp_replace(F.translate(c, _SRC, _DST), r"\p{Mn}", "")))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    return collapse_space(unaccent(c))


def contains_fold(text: Column, needle: Column) -> Column:
    return F.contains(normalize(text), normalize(needle))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, on normalised text; two empty texts are alike."""
    x, y = normalize(a), normalize(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / most)


def estimate_tokens(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, 0).otherwise(F.floor(n / 3) + 1).cast("bigint")


def history_tokens(c: Column) -> Column:
    """The other estimate: bytes by four, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("bigint")


def share(c: Column, kept: str, of: str) -> Column:
    """Characters of class `kept` by characters of class `of` (regex classes); 0 without any."""
    total = F.length(F.regexp_replace(c, f"[^{of}]", ""))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, f"[^{kept}]", "")) / total)


def bad_char_ratio(c: Column) -> Column:
    """Replacement, private-use and control characters by characters that aren't white space."""
    seen = F.regexp_replace(c, r"[\s\x{85}\x{a0}]", "")
    n = F.length(seen)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(seen, r"[^\x{fffd}\p{Co}\p{Cc}]", "")) / n)


def latin_ratio(c: Column) -> Column:
    return share(c, r"\p{IsLatin}", r"\p{L}")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def value_key(c: Column) -> Column:
    """Comparison form: digits alone when the value is digits and separators, else folded letters and digits."""
    s = F.trim(unaccent(c))
    digits = F.regexp_replace(s, r"[^\p{Nd}]", "")
    return F.when(s.rlike(r"^[\p{Nd} .,\-/_']*$") & (digits != ""), digits).otherwise(F.regexp_replace(s, r"[^\p{L}\p{Nd}]", ""))


def value_in(value: Column, text: Column) -> Column:
    v = value_key(value)
    digits = F.regexp_replace(text, r"[^\p{Nd}]", "")
    letters = F.regexp_replace(unaccent(text), r"[^\p{L}\p{Nd}]", "")
    return (v != "") & (F.contains(digits, v) | F.contains(letters, v))


def let(c: Column, body) -> Column:
    """body of c with c evaluated once, inside lambdas too."""
    return F.transform(F.array(c), body)[0]


def _plain_number(t: Column) -> Column:
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."))), F.length(t) - F.length(F.replace(t, F.lit(",")))
    no_dots, no_commas = F.replace(t, F.lit(".")), F.replace(t, F.lit(","))
    last = lambda mark: F.length(t) - F.instr(F.reverse(t), mark)
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(last(",") > last("."), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(dots > 1, no_dots)
        .when(commas > 1, no_commas)
        .when((dots == 1) & t.rlike(r"\.[^.]{3}$"), no_dots)
        .when((commas == 1) & t.rlike(r",[^,]{3}$"), no_commas)
        .when(commas == 1, F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(t)
    )
    ok = t.rlike(r"^[\p{Nd}.,\-]+$") & t.rlike(r"\p{Nd}")
    return F.when(ok, plain.try_cast("double"))


def parse_number(c: Column) -> Column:
    """A number with either decimal mark, thousands marks, spaces and a currency; null when it is none."""
    usual = c.rlike(r"^-?[0-9]+(?:\.(?:[0-9]{1,2}|[0-9]{4,}))?$")
    return F.when(usual, c.try_cast("double")).otherwise(let(F.regexp_replace(c, r"[\s\p{L}]", ""), _plain_number))


def furniture_key(c: Column) -> Column:
    """Key of a line that repeats over pages with another number."""
    return F.regexp_replace(normalize(c), r"\p{Nd}+", "#")


def sanitize(c: Column) -> Column:
    return F.replace(F.make_valid_utf8(c), F.lit("\0"), F.lit(""))


def thousands(c: Column) -> Column:
    """Dots between thousands."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unaccent(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def strip_md(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^#{1,6}\s+", ""), r"[*_`|]", ""))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse_space(c), " "), 1, n), " ")


def citation(doc: Column, page: Column, first: Column, last: Column) -> Column:
    lines = F.when(first == last, F.concat(F.lit("l"), first.cast("string"))).otherwise(F.concat(F.lit("l"), first.cast("string"), F.lit("-l"), last.cast("string")))
    return F.concat(F.lit("doc:"), doc.cast("string"), F.lit(":p"), page.cast("string"), F.lit(":"), lines)


def parse_citation(c: Column) -> Column:
    """doc, page, first and last line of a citation; null when it is none."""
    p = r"^doc:([^:]+):p(\d+):l(\d+)(?:-l?(\d+))?$"
    part = lambda i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(p), F.struct(part(1).alias("doc"), part(2).cast("int").alias("page"), part(3).cast("int").alias("first"), F.coalesce(F.nullif(part(4), F.lit("")), part(3)).cast("int").alias("last")))
