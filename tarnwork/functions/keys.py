"""Content keys, stable hash buckets and text normalisation as Column functions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}  # fixed values: JSON's short escapes


def json_string(text: Column, ascii: bool = True) -> Column:
    """The text as a JSON string; with ``ascii`` other characters are written as \\uXXXX, in pairs beyond the basic plane. Null is null."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(n == 34, SHORT[34])
        for code in (8, 9, 10, 12, 13, 92):
            out = out.when(n == code, SHORT[code])
        out = out.when(n < 32, unit(n))
        if ascii:
            above = n - 0x10000
            out = out.when(n >= 0x10000, F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(0x3FF) + 0xDC00))).when(n > 126, unit(n))
        return out.otherwise(c)

    plain = ~text.rlike(r'[^\x20-\x7e]|["\\]' if ascii else r'[\x00-\x1f"\\]')
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(characters, escaped), "")), F.lit('"'))


def json_list(items: Column, separator: str = ", ", ascii: bool = True) -> Column:
    """A list of strings as JSON; null elements are null."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(json_string(x, ascii), F.lit("null"))), separator), F.lit("]"))


def history_key(items: Column) -> Column:
    """SHA-256 of the JSON list of strings, separated by comma and space, all in ASCII."""
    return F.sha2(json_list(items), 256)


def context_key(initial: Column, moves: Column) -> Column:
    """SHA-256 of the JSON list of the initial position and the list of moves, without spaces, in UTF-8."""
    return F.sha2(F.concat(F.lit("["), F.coalesce(json_string(initial, False), F.lit("null")), F.lit(","), json_list(moves, ",", False), F.lit("]")), 256)


def prefix_key(text: Column, n: int = 2) -> Column:
    """The first n fields between white space."""
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys, in UTF-8 without spaces; values are strings, a null field is null and not left out."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(json_string(v.cast("string"), False), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def bucket(seed: str, key: Column, n: int = 100) -> Column:
    """The 256-bit SHA-256 number of seed/key, modulo n."""
    h = F.sha2(F.concat(F.lit(f"{seed}/"), key.cast("string")), 256)
    digits = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    total = F.lit(0).cast("long")
    for d in digits:
        total = (total * (2**32 % n) + d) % n
    return total


def assigned_split(seed: str, key: Column) -> Column:
    """80 in 100 train, 10 validation, 10 test, by the key alone."""
    b = bucket(seed, key)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def row_seed(seed: str, *keys: Column) -> Column:
    h = F.sha2(F.concat_ws("/", F.lit(seed), *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def single_year(text: Column) -> Column:
    """The year 1900 to 2099 that occurs in the text, if there is just one."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).cast("int"))


@pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition (NFKC), which the JVM functions lack."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Traditional characters of piece and move names, numerals, and what each is written as.
NOTATION = ("車俥馬傌帥帅將仕相砲進後一二三四五六七八九", "车车马马将将将士象炮进后123456789")


def normalize_notation(text: Column) -> Column:
    """A move's name composed, in one set of characters, without marks at its end."""
    return F.regexp_replace(F.translate(composed(text), *NOTATION), r"[!?+#]+$", "")


def normalize_answer(text: Column) -> Column:
    """White space collapsed, none at either end."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Composed, straight quotes, white space collapsed, no punctuation at the end."""
    return F.regexp_replace(normalize_answer(F.translate(composed(text), "“”‘’", "\"\"''")), r"[.!?;:, ]+$", "")


def hash_order(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(seed), *[k.cast("string") for k in keys]), 256)
