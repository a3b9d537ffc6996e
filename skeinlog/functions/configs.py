"""Text clean-up of configuration files: JSON with comments and a flat TOML subset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions import variants as V

_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SINGLE = r"'[^']*+'"


def strip_jsonc(body: Column) -> Column:
    """Remove // and /* */ comments outside of string literals."""
    pattern = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"?)|//[^\n]*+|/\*.*?(?:\*/|\z)'
    return F.regexp_replace(body, pattern, "$1")


def parse_jsonc(body: Column) -> Column:
    return F.coalesce(V.parse(body), V.parse(strip_jsonc(body)))


def strip_toml_comment(line: Column) -> Column:
    return F.regexp_replace(line, rf"""^((?:[^"'#]++|{_DOUBLE}|{_SINGLE})*+)#.*$""", "$1")


def toml_string(value: Column) -> Column:
    return F.replace(F.btrim(strings.trim(value), F.lit("\"'")), F.lit('\\"'), F.lit('"'))


def toml_array(value: Column) -> Column:
    """Items of a one-line array, quotes removed, blanks dropped."""
    inner = F.rtrim(F.ltrim(strings.trim(value), F.lit("[")), F.lit("]"))
    items = F.regexp_extract_all(inner, F.lit(rf"""(?:[^,"']++|{_DOUBLE}|{_SINGLE})++"""), F.lit(0))

    def plain(item: Column) -> Column:
        t = strings.trim(item)
        unquoted = F.regexp_replace(t, rf"""^'([^']*)'$|^"(.*)"$""", "$1$2")
        return F.when(t.startswith('"'), F.regexp_replace(unquoted, r"\\(.)", "$1")).otherwise(unquoted)

    return F.filter(F.transform(items, plain), lambda i: i != "")
