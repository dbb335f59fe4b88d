"""Text functions as Column expressions; only compatibility normalization needs a Python worker."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, in Java's pattern syntax.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What case folding makes of letters where lower-casing alone gives other ASCII letters.
FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if c.lower() != c.casefold() and re.search("[a-z0-9]", c.casefold())}
#: The Han ranges.
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))


#: Characters from U+00A0 to U+02FF that compatibility normalization leaves alone; a text of these and ASCII is normalized already.
_STABLE = [c for c in range(0xA0, 0x300) if unicodedata.normalize("NFKC", chr(c)) == chr(c)]
_SETTLED = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip([c for c in _STABLE if c - 1 not in _STABLE], [c for c in _STABLE if c + 1 not in _STABLE], strict=True))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode compatibility normalization; only texts that it may change go to a Python worker."""
    unsettled = F.rlike(c, F.lit(f"[\\x{{a0}}-\\x{{10ffff}}&&[^{_SETTLED}]]"))  # a range first, which ASCII fails at once
    return F.coalesce(_nfkc(F.when(unsettled, c)), c)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, also in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def nonblank(c: Column) -> Column:
    """Stripped, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column, normalize: bool = True) -> Column:
    """Compatibility-normalized, without control and format characters, white space collapsed to single spaces."""
    c = nfkc(c) if normalize else c
    c = F.regexp_replace(c, r"[\n\t\r]", " ")
    c = F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Co}]", "")
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def casefold(c: Column) -> Column:
    """Case folding as far as ASCII letters and digits can tell."""

    def folded(low: Column) -> Column:
        changed = reduce(lambda x, f: F.replace(x, F.lit(f[0]), F.lit(f[1])), FOLDS.items(), low)
        return F.when(F.rlike(low, F.lit(f"[{''.join(FOLDS)}]")), changed).otherwise(low)

    return bind(F.lower(c), folded)


def normalized_words(c: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(casefold(c), F.lit("([a-z0-9]+)"), F.lit(1))


def word_shingles(words: Column, width: int) -> Column:
    """Every run of `width` words, joined by spaces, in order; none if there are fewer words."""

    def cut(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.when(F.size(w) >= width, F.transform(at, lambda i: F.array_join(F.slice(w, i, width), " "))).otherwise(F.array().cast("array<string>"))

    return bind(words, cut)


def segments(c: Column, most: int) -> Column:
    """Pieces of at most so many characters; an empty text is one empty piece."""

    def cut(t: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(most))
        return F.transform(at, lambda i: F.substring(t, i + 1, F.lit(most)))

    return bind(c, cut)


def slug(c: Column) -> Column:
    """Letters, digits, _ and - in lower case, other runs as one -; an error if nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""))
    return F.when(s == "", F.raise_error(F.lit("a source name has no letters or digits"))).otherwise(s)


def source_slug(name: str) -> str:
    """What `slug` gives for one name."""
    s = re.sub("[^a-zA-Z0-9_-]+", "-", name).strip("-").lower()
    if not s:
        raise ValueError("a source name has no letters or digits")
    return s


def render(template: str, columns: dict[str, Column]) -> Column:
    """A template's {field} placeholders filled with stripped fields; null if any is null or blank."""
    parts, needed = [], []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if not name.isidentifier() or spec or conversion:
            raise ValueError(f"a placeholder must be a plain field name: {name!r}")
        if name not in columns:
            raise ValueError(f"the template names an unknown field: {name!r}")
        needed.append(nonblank(columns[name]))
        parts.append(needed[-1])
    if not needed:
        raise ValueError("the template has no field")
    return F.when(reduce(lambda a, b: a & b, (n.isNotNull() for n in needed)), strip(F.concat(*parts)))


def wiki_detokenize(c: Column) -> Column:
    """Undo the spacing of the WikiText corpora."""
    # Fixed values, applied in this order.  R: pattern, L: literal.
    steps = (
        ("L", "s '", "s'"),
        ("R", "/' [0-9]/", "/'[0-9]/"),
        ("L", " @-@ ", "-"),
        ("L", " @,@ ", ","),
        ("L", " @.@ ", "."),
        ("L", " : ", ": "),
        ("L", " ; ", "; "),
        ("L", " . ", ". "),
        ("L", " ! ", "! "),
        ("L", " ? ", "? "),
        ("L", " , ", ", "),
        ("R", r"\(\s*([^\)]*?)\s*\)", "($1)"),
        ("R", r"\[\s*([^\]]*?)\s*\]", "[$1]"),
        ("R", r"\{\s*([^}]*?)\s*\}", "{$1}"),
        ("R", r'"\s*([^"]*?)\s*"', '"$1"'),
        ("R", r"'\s*([^']*?)\s*'", "'$1'"),
        ("L", "= = = =", "===="),
        ("L", "= = =", "==="),
        ("L", "= =", "=="),
        ("L", " ° ", "°"),
        ("L", " \n", "\n"),
        ("L", "\n ", "\n"),
        ("L", " N ", " 1 "),
        ("L", " 's", "'s"),
    )
    for kind, old, new in steps:
        c = F.replace(c, F.lit(old), F.lit(new)) if kind == "L" else F.regexp_replace(c, old.replace(r"\s", SPACE), new)
    return c


def spaced_parts(c: Column) -> Column:
    """Parts between runs of white space, empty ones at the ends included."""
    return F.size(F.split(c, f"{SPACE}+", -1))


def has_han(c: Column) -> Column:
    return F.rlike(c, F.lit("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in HAN) + "]"))


def looks_base64(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[ \t]*[A-Za-z0-9+/]{16,}={0,2}$")) & F.rlike(c, F.lit("[0-9]"))


def looks_hex(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[ \t]*[0-9A-Fa-f]{16,}$"))


def looks_word(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[ \t]*[A-Za-z][A-Za-z-]{3,}$"))


def has_control(c: Column) -> Column:
    return F.rlike(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))


def mostly_ascii_letters(c: Column) -> Column:
    """Whether 7 of 10 letters, at least, are A-Z or a-z; false without letters."""
    letters = lambda t, pattern: F.length(F.regexp_replace(t, pattern, ""))
    return bind(c, lambda t: letters(t, "[^A-Za-z]") >= 0.7 * F.greatest(letters(t, r"[^\p{L}]"), F.lit(1)))


def until_stops(c: Column, stops: list[str]) -> Column:
    """Up to the first of each stop in turn."""
    return reduce(lambda x, s: F.substring_index(x, s, 1), [s for s in stops if s], c)


def lines_of(docs: DataFrame, most: int = 4_000, text_col: str = "text", most_documents: int | None = None) -> DataFrame:
    """Rows (value): cleaned texts that aren't empty as lines of at most so many characters, of all documents or the first ones by row_id."""
    rows = docs.select(clean(F.col(text_col)).alias("t"), *(["row_id"] if most_documents is not None else [])).where("t <> ''")
    if most_documents is not None:
        rows = rows.orderBy("row_id").limit(most_documents)
    return rows.select(F.explode(segments(F.col("t"), most)).alias("value"))


def number(c: Column, digits: int = 0) -> Column:
    """With thousands separators; a dash for null."""
    return F.coalesce(F.format_number(c, digits), F.lit("—"))


#: Byte-level alphabets write a byte that isn't printable as a character beyond 255: this gives the byte of each character.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def byte_level_hex(c: Column) -> Column:
    """The bytes of a byte-level token, in hex."""
    table = F.create_map(*(F.lit(x) for c, b in BYTE_OF.items() for x in (c, f"{b:02X}")))
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: table[x]), "")
