"""Column functions on texts and queries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscore of any script (fixed value).
TOKEN = r"[\p{L}\p{N}_]+"
#: Words that mark a Vietnamese text written without accents (fixed values).
SIGNAL_TOKENS = "ao ban cau cua dang den do duoc gi la nguoi nhung noi o trong voi".split()
#: The same for query planning, where they must also be a quarter of all words (fixed values).
PLANNER_TOKENS = "ao con cuc dan den do gioi hanh hiem ho mau mien moi nam nguoi phi phong quang quy sinh tau them thieu tin tru tu vai vu".split()


def tokenize(text: Column) -> Column:
    """Lower-case word tokens of more than one character, in order; a null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) > 1)


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """Without accents, in lower case, only a-z and 0-9, runs of anything else one blank."""

    def fold(text: str | None) -> str:
        plain = unicodedata.normalize("NFKD", (text or "").replace("đ", "d").replace("Đ", "D"))
        kept = (c if c.isascii() and c.isalnum() else "" if unicodedata.combining(c) else " " for c in plain.lower())
        return " ".join("".join(kept).split())

    return texts.map(fold)


def looks_vietnamese(text: Column, signals: tuple[str, ...] = tuple(SIGNAL_TOKENS)) -> Column:
    """Accented letters, or at least two distinct signal words among the runs of a-z."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-z]+)"), F.lit(1)))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, signals))))
    return F.coalesce(text, F.lit("")).rlike("[À-ỹ]") | (hits >= 2)


def planner_vietnamese(text: Column, folded: Column) -> Column:
    """Accented letters, or at least two signal words that are a quarter of the folded text's words."""
    words = F.regexp_extract_all(folded, F.lit("([a-z]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*PLANNER_TOKENS)))
    return F.coalesce(text, F.lit("")).rlike("[À-ỹ]") | ((hits >= 2) & (hits / F.greatest(F.size(words), F.lit(1)) >= 0.25))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def dedupe_variants(values: Column, most: int) -> Column:
    """Squashed, without blanks-only ones, the first of each regardless of case, at most max(1, most)."""
    clean = F.filter(F.transform(values, squash), lambda v: v != "")
    first = F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda kept, v: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.concat(kept, F.array(v))),
    )
    return F.slice(first, 1, max(1, most))


def query_cues(text: Column) -> Column:
    """Quoted spans of up to 80 characters, then codes of capitals and digits; each once."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit("[\"'“”]([^\"'“”]{1,80})[\"'“”]"), F.lit(1)), lambda c: F.trim(c))
    # Java's own word boundary takes letters beyond ASCII for words in some releases only.
    word = r"[\p{L}\p{N}_]"
    codes = F.regexp_extract_all(text, F.lit(rf"(?<!{word})([A-Z0-9][A-Z0-9._:/-]+)(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(quoted, codes), lambda c: c != ""))


def minimum_should_match(text: Column) -> Column:
    """How many of a query's blank-separated terms a hit needs: all of up to two, 75 % of up to four, else half."""
    n = F.size(F.filter(F.split(squash(text), " "), lambda t: t != ""))
    return F.when(n <= 2, n).when(n <= 4, F.floor(n * 0.75)).otherwise(F.floor(n * 0.5)).cast("int")


def answer_display(text: Column) -> Column:
    """One line of at most 100 characters."""
    return F.rtrim(F.substring(squash(text), 1, 100))


def answer_match(text: Column) -> Column:
    """The form in which answers are compared: lower case, words only, single blanks."""
    return squash(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""))


_COLLAPSED = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("runs", "removed", "raw_words", "clean_words"))])


@F.pandas_udf(_COLLAPSED)
def collapse_repeats(texts: pd.Series) -> pd.DataFrame:
    """Runs of at least three equal neighbouring phrases of up to eight words become one phrase, its first.

    Words are compared regardless of case and of compatibility forms. At each place the phrase whose run covers most
    words wins, the shorter of equals. Also the numbers of words before and after.
    """

    def collapse(text: str | None) -> tuple[str, int, int, int, int]:
        words = unicodedata.normalize("NFC", text or "").split()
        keys = [unicodedata.normalize("NFKC", w).casefold() for w in words]
        out, runs, removed, i = [], 0, 0, 0
        while i < len(words):
            best = (0, 0)
            for width in range(1, min(8, (len(words) - i) // 3) + 1):
                phrase, end = keys[i : i + width], i + width
                while keys[end : end + width] == phrase:
                    end += width
                if end - i >= 3 * width and end - i > best[0]:
                    best = (end - i, width)
            cover, width = best
            if cover:
                out += words[i : i + width]
                runs, removed, i = runs + 1, removed + cover - width, i + cover
            else:
                out.append(words[i])
                i += 1
        return " ".join(out), runs, removed, len(words), len(out)

    return pd.DataFrame([collapse(t) for t in texts], columns=_COLLAPSED.names)


#: Marks of UTF-8 that was read as Latin-1 (fixed values).
MOJIBAKE = ("Ã", "Ä", "Å", "Æ", "Â", "á»", "áº")


@F.pandas_udf(T.StringType())
def repair_mojibake(texts: pd.Series) -> pd.Series:
    """Up to two times UTF-8 that was read as Latin-1 is read anew, while it shows the usual marks."""

    def repair(text: str | None) -> str | None:
        for _ in range(2):
            if not text or not any(m in text for m in MOJIBAKE):
                break
            try:
                text = text.encode("latin-1").decode("utf-8")
            except UnicodeError:
                break
        return text

    return texts.map(repair)
