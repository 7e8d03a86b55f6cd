"""Column functions on text: stripping, matching, numbers, dates, names and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and a dot that stops at a line feed only.
UNICODE = "(?Ud)"
# fixed values: the white space of Unicode and the four separators of ASCII
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: full-width digits
FULL_WIDTH = "０１２３４５６７８９"


def regex(pattern: str) -> str:
    """The pattern with the flags it needs: classes of Unicode cost time, so only where a class is named."""
    return (UNICODE if re.search(r"\\[sSdDwWbB]", pattern) else "(?d)") + pattern


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def first_group(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match."""
    return F.when(c.rlike(regex(pattern)), F.regexp_extract(c, regex(pattern), 1))


def meaningful(c: Column, least: int = 10) -> Column:
    """Whether a text has so many letters and digits."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= least


def numbers(c: Column, pattern: str, groups: int = 2) -> Column:
    """All numbers that the pattern's groups catch; groups that did not match are left out."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(UNICODE + pattern), F.lit(g + 1)) for g in range(groups)])
    plain = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.translate(x, FULL_WIDTH, "0123456789").try_cast("double"))
    return F.filter(plain, lambda x: x.isNotNull())


def show_number(x: Column) -> Column:
    """Whole numbers without decimals, others in full, never with an exponent."""
    whole, long = x.cast("decimal(38,0)").cast("string"), F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+\z", "")
    return F.when(x == F.floor(x), whole).when(F.abs(x) < 1e7, x.cast("string")).otherwise(long)


def iso_date(c: Column) -> Column:
    """ISO date of a text with year, month and day as its first three numbers; null if that is no date.

    Digits of full width are digits too."""
    parts = F.regexp_extract_all(F.translate(c, FULL_WIDTH, "0123456789"), F.lit(r"([0-9]+)"), F.lit(1))
    day = F.try_to_date(F.array_join(F.slice(parts, 1, 3), "-"), "yyyy-M-d")
    return F.when((F.size(parts) >= 3) & (F.year(day) > 0), F.date_format(day, "yyyy-MM-dd"))


def file_type(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\.+", "")


def safe_name(c: Column, fallback: str) -> Column:
    """The last path component with characters that file systems refuse replaced; the fallback if none is left."""
    # fixed values: the characters refused in names
    base = F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    clean = F.regexp_replace(strip(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+\z", "")
    return F.when(clean.isin("", ".", "..") | clean.isNull(), F.lit(fallback)).otherwise(clean)


def storage_path(root: Column, code: Column, attachment: Column, name: Column) -> Column:
    """Where an attachment's file is kept: ``root/code/attachment_name`` of safe names. An error if that lies anywhere but
    right in the folder of its approval."""
    # fixed values: what stands for a part of which nothing is left
    folder = F.concat_ws("/", F.regexp_replace(root, r"/+\z", ""), safe_name(code, "unknown_approval"))
    path = F.concat_ws("/", folder, F.concat_ws("_", safe_name(attachment, "attachment"), safe_name(name, "contract_file")))
    within = F.substring_index(path, "/", -1).isin(".", "..") | ~path.startswith(F.concat(folder, F.lit("/"))) | F.substr(path, F.length(folder) + 2).contains("/")
    return F.when(within, F.raise_error(F.concat(F.lit("the path leaves the folder of its approval: "), path)).cast("string")).otherwise(path)


def schema_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_"), 1, 64)


def folded(c: Column) -> Column:
    """For comparing a value with its evidence: no white space, punctuation or date glyphs, lower case."""
    # fixed values: what a value may be written with and without
    return F.lower(F.regexp_replace(c, r"(?U)[\s,，。；;：:（）()￥¥$\-年月日/]", ""))


def supported(value: Column, evidence: Column) -> Column:
    """Whether the value, folded and not empty, stands in its evidence."""
    v = folded(value)
    return F.coalesce((v != "") & folded(evidence).contains(v), F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def set_fingerprint(parts: Column) -> Column:
    """SHA-256 of an array of texts, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)
