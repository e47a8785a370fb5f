import pytest
from pyspark.sql import functions as F

from quern.functions import globs, text

GLOBS = [
    ("hello", "hello", True), ("hello", "helloo", False), ("h?llo", "hllo", False), ("?", "", False), ("h[ae]llo", "hallo", True), ("test[0-9]", "testa", False), ("test[!0-9]", "testa", True), ("*", "", True),
    ("hello*world", "helloworld", True), ("*hello*world*", "hello beautiful", False), ("*-literal", "aaa-literl", False), ("*-literal", "-literal", True), ("literal-*", "literal", False), ("*.[ch]", "file.cpp", False),
    ("test?*", "test", False), ("test\\*", "test*", True), ("a**b", "aXXXb", True), ("[abc", "a", False), ("[]", "a", False), ("test\\", "test", False), ("[]a]", "]", True), ("a*", "a\nb", True),
]


@pytest.mark.parametrize("pattern,value,expected", GLOBS)
def test_glob(pattern, value, expected):
    assert globs.matches(pattern, value) is expected


def test_glob_columns(spark):
    rows = spark.createDataFrame(GLOBS, "p string, t string, e boolean")
    assert rows.where(globs.glob_match_columns("t", "p") != F.col("e")).count() == 0
    for p, t, e in GLOBS:
        assert spark.range(1).select(globs.glob_match(F.lit(t), p)).first()[0] is e


def test_glob_enumeration():
    assert globs.enumerate_strings("a[bc]") == ["ab", "ac"]
    assert globs.enumerate_strings("a*") == [] and globs.enumerate_strings("??") == [] and len(globs.enumerate_strings("?")) == 95


CASES = [
    (text.as_tr_sh, "$feature_name", "feature_name"), (text.as_tr_sh, "feature-name/value", "feature_name_value"), (text.as_tr_sh, "1.2.3", "_1_2_3"), (text.sanitize_c_name, "char *", "CHAR_P"),
    (text.sanitize_package, "libfoo-dev", "FOO"), (text.sanitize_version, "v1.2.3-rc1+b x", "1.2.3-rc1+b"), (text.sanitize_version, "none", None), (text.crate_name, "My Lib", "my-lib"), (text.substitution, '"@X_1@"', "X_1"),
    (text.substitution, "1", None), (text.strip_underscore, "_a__b_", "a_b"), (text.escape_rust, 'a"\\\t\0\x01\n', 'a\\"\\\\\\t\\0\\u{1}\n'), (text.merge_continuations, "a \\\nb", "a  b"),
    (text.strip_comments, 'x = "//no"; // yes\n/* a\nb */y', 'x = "//no" ;  \n y'), (text.trailing_backslashes, "a\\\\", 2), (text.normalize_path, "a/./b/../c", "a/c"), (text.normalize_path, "/../a", "/a"),
    (text.is_numeric, "", True), (text.is_boolean, "on", True), (text.is_header_literal, '"a"', True), (text.known_value, "CC", "cc"), (text.split_ifs, " a  b ", ["a", "b"]), (text.split_triplet, "a-[b-c]-d", ["a", "[b-c]", "d"]),
]


@pytest.mark.parametrize("function,given,expected", CASES)
def test_text(spark, function, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(function(F.col("t"))).first()[0] == expected


def test_dictionary_names(spark):
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("Name", "prefix_"), ("Indirect", "a"), ("Indirect", "b"), ("Name", "_suffix"))])
    row = spark.range(1).select(text.encode_dictionary_id(parts).alias("i")).select("i", text.dictionary_name(F.col("i")).alias("n")).first()
    assert tuple(row) == ("prefix_@_suffix", "prefix_suffix")
