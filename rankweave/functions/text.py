"""Text rules as column expressions: tokens, personal data, secrets, injection signals, languages, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, and query words that say nothing about the work.
TOKEN_SEPARATOR = "[^a-z0-9_+#.]+"
STOPWORDS = (
    "experience experienced team development developer required requirement requirements responsible responsibility looking need needs work working role skills skill "
    "knowledge ability strong good using used use and the for with kinh nghiem yeu cau lam viec co kha nang uu tien diem cong bat buoc"
).split()

#: Patterns that Java, RE2 and Python read alike; a first group holds the character before a match.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(^|[^0-9A-Za-z_])(\+?84|0)[35789][0-9]([ .-]?[0-9]){7,8}([^0-9A-Za-z_]|$)"
URL = r"(https?://|www\.)[^ \t\n\r]+|(linkedin|github|facebook|twitter|x)\.com/[^ \t\n\r]+"
BIRTH = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
#: Letters of the Vietnamese and western European alphabets by what they fold to.
ACCENTS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåą", "e": "èéẻẽẹêềếểễệëę", "i": "ìíỉĩịîï", "o": "òóỏõọôồốổỗộơờớởỡợöø",
    "u": "ùúủũụưừứửữựûü", "y": "ỳýỷỹỵÿ", "d": "đ", "n": "ñń", "c": "çć",
}
ACCENTED, FOLDED = "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items())
LOW_CONTENT = 600


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TOKEN_SEPARATOR), "")


def query_tokens(text: Column) -> Column:
    """Tokens without stopwords; repeated ones stay, and count each time."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


def fold(text: Column) -> Column:
    """Lower case without accents, spaces squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, FOLDED), r"[ \t\n\r]+", " "))


#: Punctuation that may end a word without being part of a skill's name.
WORD_END = r"[.,;:!?)\]]+(\s|$)"


def unaccented(low: Column) -> Column:
    """A lower-cased text without accents; one of single bytes has none, and is not looked at."""
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, ACCENTED, FOLDED), r"[\x{300}-\x{36F}]+", ""))


#: White space that is not one blank, for squeezing.
UNEVEN = r"[\t\n\x0B\f\r]\s*| \s+"


def matched(text: Column) -> Column:
    """The form in which skills are matched: lower case without accents, no punctuation at the end of words, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(F.lower(text)), WORD_END, " "), UNEVEN, " "))


def sql_matched(text: str) -> str:
    plain = f"regexp_replace(translate(lower({text}), '{ACCENTED}', '{FOLDED}'), '[\\x{{300}}-\\x{{36F}}]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '{WORD_END}', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def pii_counts(text: Column) -> dict[str, Column]:
    patterns = {"emails": EMAIL, "phones": PHONE, "urls": URL, "births": BIRTH}
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in patterns.items()}


def url_parts(url: Column) -> dict[str, Column]:
    return {
        "scheme": F.regexp_extract(url, r"^([a-z]+)://", 1), "host": F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1),
        "path": F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "query": F.regexp_extract(url, r"\?([^#]*)", 1), "fragment": F.regexp_extract(url, r"#(.*)$", 1),
    }


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def looks_corrupted(text: Column) -> Column:
    """Replacement characters, control characters, or over a tenth of the lines of one or two characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tiny = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 2))
    return text.contains("�") | text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | (tiny * 10 > F.size(lines))
