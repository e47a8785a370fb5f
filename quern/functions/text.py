"""String functions of the build-script domain as Column expressions; a null gives a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOLEAN_WORDS = ("yes", "no", "0", "1", "true", "false", "on", "off")
C_EXTENSIONS = ("c", "cc", "cpp")
H_EXTENSIONS = ("h", "hh", "hpp")
SOURCE_SUFFIXES = ("", ".c", ".cc", ".cpp", ".asm", ".s", ".S")
KNOWN_VALUES = {"CC": "cc", "AWK": "awk"}


def as_tr_sh(text: Column) -> Column:
    """A shell variable name: one leading ``$`` goes, other characters become ``_``, a leading digit gets one before it."""
    name = F.regexp_replace(F.regexp_replace(text, r"^\$", ""), "[^A-Za-z0-9_]", "_")
    return F.regexp_replace(name, "^([0-9])", "_$1")


def sanitize_c_name(text: Column) -> Column:
    """A C macro name: ``*`` becomes P, letters upper case, all but letters and digits ``_``."""
    return F.regexp_replace(F.upper(F.replace(text, F.lit("*"), F.lit("P"))), "[^A-Z0-9]", "_")


def cfg_name(text: Column) -> Column:
    return F.lower(sanitize_c_name(text))


def automake_canonicalize(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def sanitize_package(text: Column) -> Column:
    """``libfoo-dev`` to ``FOO``."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, "^lib|-dev$", ""), "[^A-Za-z0-9]", "_"))


def sanitize_version(text: Column) -> Column:
    """The first version in a text: major, minor and patch, with pre-release and build parts; null if there is none."""
    found = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?(?:\.[0-9]+)?(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)", 1)
    return F.when(found != "", found)


def crate_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_-]", "-"))


def is_boolean(text: Column) -> Column:
    return text.isin(*BOOLEAN_WORDS)


def is_numeric(text: Column) -> Column:
    """All characters are numbers; true for the empty text."""
    return text.rlike(r"^\p{N}*$")


def is_header_literal(text: Column) -> Column:
    """A quoted string, or digits only (also none)."""
    return text.rlike(r'^(".*"|[0-9]*)$')


def substitution(text: Column) -> Column:
    """The name in ``@NAME@``, with or without quotes; null if there is none."""
    found = F.regexp_extract(text, r'^"?@([A-Za-z_][A-Za-z0-9_]*)@"?$', 1)
    return F.when(found != "", found)


def split_ifs(text: Column, separator: str | None = None) -> Column:
    """Fields between separators (default: white space), empty ones dropped."""
    parts = F.split(text, r"\s+") if separator is None else F.split(text, "\\Q" + separator + "\\E")
    return F.filter(parts, lambda x: x != "")


def strip_underscore(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "_"), lambda x: x != ""), "_")


def escape_rust(text: Column) -> Column:
    r"""For a Rust string literal: quotes, backslashes, CR, TAB and NUL escaped, other controls as ``\u{..}``, line feeds kept."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    for code in [*range(1, 9), 11, 12, *range(14, 32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    return out


def merge_continuations(text: Column) -> Column:
    """Lines that end with a backslash (and blanks) go on with the next one after a space."""
    return F.regexp_replace(text, r"\\[ \t]*\n", " ")


def strip_comments(text: Column) -> Column:
    """C comments become a space, string literals stay."""
    return F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|/\*(?s:.*?)\*/|//[^\n]*', "$1 ")


def trailing_backslashes(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"(\\*)$", 1))


def split_triplet(text: Column) -> Column:
    """Parts between dashes outside of brackets."""
    return F.split(text, r"-(?![^\[]*\])")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def is_c_file(path: Column) -> Column:
    return extension(path).isin(*C_EXTENSIONS)


def is_h_file(path: Column) -> Column:
    return extension(path).isin(*H_EXTENSIONS)


def normalize_path(path: Column) -> Column:
    """``.`` parts go, ``..`` takes the part before it with it; a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def includes(text: Column) -> Column:
    """Files that a C text includes."""
    return F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]'), F.lit(1))


def has_word(text: Column, word: str) -> Column:
    """Whether an ASCII word stands in a text on its own."""
    return text.rlike(rf"(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")


def prefixed_symbol(symbol: Column, prefix: Column) -> Column:
    """A C symbol behind the project's prefix, upper case if it begins so; a null prefix changes nothing."""
    own = F.when(symbol.rlike("^[A-Z]"), F.upper(prefix)).otherwise(F.lower(prefix))
    return F.coalesce(F.concat(own, symbol), symbol)


def known_value(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in KNOWN_VALUES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def encode_dictionary_id(parts: Column) -> Column:
    """Name parts joined by ``_``; a run of parts that are read indirectly becomes one ``@``.  parts: array<struct<kind, text>>."""
    coded = F.transform(parts, lambda p: F.when(p["kind"] == "Name", p["text"]).otherwise("@"))
    once = F.filter(F.transform(coded, lambda x, i: F.when((x == "@") & (i > 0) & (F.get(coded, i - 1) == "@"), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return F.array_join(once, "")


def dictionary_name(dict_id: Column) -> Column:
    return strip_underscore(F.replace(dict_id, F.lit("@"), F.lit("")))
