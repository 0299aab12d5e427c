"""Column functions on dotted tree paths."""

from __future__ import annotations

import sys
import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelark.functions.text import once


def labels(path: Column) -> Column:
    return F.split(path, "\\.")


def nlevel(path: Column) -> Column:
    return F.size(labels(path)).cast("long")


def subpath(path: Column, offset: int, length: int | None = None) -> Column:
    """Labels from offset (0-based; negative from the end) on, `length` of them."""
    parts = labels(path)
    start = F.lit(offset) if offset >= 0 else F.size(parts) + offset
    n = F.size(parts) - start if length is None else F.lit(length)
    return F.array_join(F.slice(parts, start + 1, n), ".")


def parent_path(path: Column) -> Column:
    """Null at the root."""
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", ""))


def ancestors(path: Column, with_self: bool = False) -> Column:
    """The prefixes of a path, shortest first."""
    parts = labels(path)
    n = F.size(parts) if with_self else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array().cast("array<string>"))


def is_strictly_under(path: Column, anchor: Column) -> Column:
    return path.startswith(F.concat(anchor, F.lit(".")))


def is_under(path: Column, anchor: Column) -> Column:
    return (path == anchor) | is_strictly_under(path, anchor)


def is_valid_path(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^[A-Za-z0-9_]{1,255}(\.[A-Za-z0-9_]{1,255})*$"), F.lit(False))


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without combining marks is one ASCII character, these characters, and those where it is several.

    Combining marks stand behind the first ones, without a partner, so that translate() takes them away.
    """
    single, several, marks = {"đ": "d", "Đ": "D"}, {}, []
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.category(c) in ("Cs", "Cn", "Co"):
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isascii() and len(plain) == 1:
            single[c] = plain
        elif plain != c and any(x.isascii() and x.isalnum() for x in plain):
            several[c] = plain
    return "".join(single) + "".join(marks), "".join(single.values()), several


MARKED, PLAIN, SEVERAL = _decomposed()
#: The characters of SEVERAL as ranges: a class of single ones is tried one by one.
SPELT = "[" + "".join(f"\\x{{{own[0]:x}}}-\\x{{{own[-1]:x}}}" for own in ([x for _, x in run] for _, run in groupby(enumerate(sorted(map(ord, SEVERAL))), lambda x: x[1] - x[0]))) + "]"
BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def spell_out(text: Column) -> Column:
    """Ligatures, numerals and the like as the characters that they are made of."""
    table = F.map_from_arrays(*[F.split(F.lit("\n".join(x)), "\n") for x in (SEVERAL.keys(), SEVERAL.values())])
    some = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(has_marks(text) & text.rlike(SPELT), some).otherwise(text)


def has_marks(text: Column) -> Column:
    """Whether a text has other characters than ASCII."""
    return F.octet_length(text) > F.char_length(text)


def sanitise_label(raw: Column) -> Column:
    """A title as a label: letters decomposed and stripped of marks, other characters to `_`, lower case, 250 at most; other scripts give u_ and a hash.

    Null for a title without letters or digits.
    """
    def label_of(clean: Column) -> Column:
        plain = F.when(has_marks(clean), F.translate(spell_out(clean), MARKED, PLAIN)).otherwise(clean)
        label = F.lower(F.regexp_replace(plain, "[^A-Za-z0-9_]+", "_"))
        label = F.regexp_replace(F.substring(F.regexp_replace(label, "^_+|_+$", ""), 1, 250), "_+$", "")
        named = lambda x: F.when(x == "", F.concat(F.lit("u_"), F.substring(F.md5(clean), 1, 12))).otherwise(x)
        return F.when(clean.rlike(r"[\p{L}\p{N}]"), once(label, named))

    return once(strip(raw), label_of)


def canonical_path(raw: Column) -> Column:
    """Separators / \\ . to dots, each segment sanitised; segments without letters or digits go."""
    parts = F.filter(F.transform(F.split(raw, r"[/\\.]+"), sanitise_label), lambda s: s.isNotNull())
    return F.array_join(parts, ".")


# Prefixes of statute labels, their display forms, and whether what follows is upper-cased.
SEGMENTS = [("tieu_muc_", "Tiểu mục ", True), ("phu_luc_", "Phụ lục ", True), ("chuong_", "Chương ", True), ("phan_", "Phần ", True), ("muc_", "Mục ", True), ("dieu_", "Điều ", False), ("khoan_", "Khoản ", False)]


def humanise(segment: Column) -> Column:
    """chuong_i -> Chương I, dieu_15a -> Điều 15a; other segments as they are."""
    out = segment
    for prefix, shown, upper in SEGMENTS:
        rest = F.translate(F.substr(segment, F.lit(len(prefix) + 1)), "_", " ")
        out = F.when(F.lower(segment).startswith(prefix), F.concat(F.lit(shown), F.upper(rest) if upper else rest)).otherwise(out)
    return out


def natural_key(path: Column) -> Column:
    """A sort key that orders digit runs of any length as numbers, and Roman numerals up to xxx as numbers: a number stands behind the count of its digits."""
    def roman(n: int) -> str:
        tens, ones = divmod(n, 10)
        return "x" * tens + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][ones]

    numerals = F.create_map(*[F.lit(x) for n in range(1, 31) for x in (roman(n), str(n))])
    tokens = F.expr(f"regexp_extract_all({_sql(path)}, '[0-9]+|[^0-9._]+|[._]', 0)") if isinstance(path, str) else F.regexp_extract_all(path, F.lit("[0-9]+|[^0-9._]+|[._]"), F.lit(0))
    number = lambda t: F.coalesce(numerals[F.lower(t)], F.when(t.rlike("^[0-9]+$"), t))
    plain = lambda n: F.regexp_replace(n, "^0+(?=.)", "")
    sized = lambda n: F.concat(F.lpad(F.length(plain(n)).cast("string"), 9, "0"), plain(n))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(sized(number(t)), t)), "")


def _sql(name: str) -> str:
    return f"`{name}`"
