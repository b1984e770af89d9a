"""Texts in one normal form: Java-side for what tables know, an Arrow step for the rows that hold anything else."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.guardrails import let
from rankweave.functions.text import ACCENTED, FOLDED

#: What folds by the table alone: ASCII, and the accented letters that it lists, in either case.
_PLAIN = f"^[\\x00-\\x7F{ACCENTED}{ACCENTED.upper().replace('SS', '')}]*$"
#: What is its own NFC: code points below the first combining mark compose with nothing.
_COMPOSED = r"^[\x00-\x{2FF}\x{1EA0}-\x{1EF9}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]*$"


@F.pandas_udf(T.StringType())
def _nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _folded(t: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", plain.replace("đ", "d")).strip()

    return t.map(one)


def nfc(text: Column) -> Column:
    """The text in NFC. Rows that may need it are all that Python sees; null stays null."""
    return F.when(text.rlike(_COMPOSED), text).otherwise(_nfc(F.when(~text.rlike(_COMPOSED), text)))


def folded(text: Column) -> Column:
    """Lower case without accents, compatible forms (full width, ligatures) as plain ones, spaces squeezed; null stays null.

    Rows of ASCII and the table's letters never leave the JVM.
    """
    by_table = F.btrim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, FOLDED), r"[ \t\n\r\x0B\x0C\x1C-\x1F]+", " "))
    return F.when(text.rlike(_PLAIN), by_table).otherwise(_folded(F.when(~text.rlike(_PLAIN), text)))


def words(text: Column) -> Column:
    """The lower-cased runs of letters that touch no digit or underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])"), F.lit(0))


#: What a pattern's \s takes for space under (?U).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """text without space at its ends, of any script: what replacing (?U)^\\s+|\\s+$ gives, without a pattern's look at every character."""
    return F.btrim(text, F.lit(SPACES))
