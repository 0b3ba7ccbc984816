"""Surface features of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .labels import SPACE, strip, word_count

#: The words, stems and phrases that the features count.
HEDGES = ("may", "might", "could", "possibly", "potentially", "likely", "unlikely")
HEDGE_STEMS = ("suggest", "indicat", "appear", "putative")
FIRST_PERSON = ("we", "our", "us", "ours")
FORMS_OF_BE = ("is", "are", "was", "were", "be", "been", "being")
STATISTIC_PHRASES = ("CI", "confidence interval", "odds ratio", "hazard ratio")

_any = "|".join
#: A token is a word of letters, with apostrophes and hyphens inside or at its end, or a number.
TOKEN = r"[A-Za-z][A-Za-z'-]*|\d[\d.,]*"
#: A sentence ends in . ! or ?, followed by white space and a capital or an opening bracket.
SENTENCE_BREAK = rf"[.!?]{SPACE}+[A-Z(]"
HEDGE = rf"(?iU)\b(?:{_any(HEDGES)}|(?:{_any(HEDGE_STEMS)})\w*)\b"
FIRST = rf"(?iU)\b(?:{_any(FIRST_PERSON)})\b"
#: A form of be, perhaps an adverb in -ly, and a word in -ed.
PASSIVE = rf"(?iU)\b(?:{_any(FORMS_OF_BE)})\s+(?:\w+ly\s+)?\w+ed\b"
#: Two capitals or more, then letters, digits and hyphens.
ACRONYM = r"(?U)\b[A-Z]{2,}[A-Za-z0-9-]*\b"
#: A p-value, a percentage, ± or one of the phrases.
STATISTIC = rf"(?iU)\bp\s*[<=>]\s*0?\.\d|\d\s*%|±|\b{STATISTIC_PHRASES[0]}\b|{_any(STATISTIC_PHRASES[1:2])}|\b(?:{_any(STATISTIC_PHRASES[2:])})\b"


def tokens(text: Column) -> Column:
    """Words and numbers in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def moving_ttr(words: Column, window: int = 50, step: int = 5) -> Column:
    """Mean type-token ratio of sliding windows over lower-case tokens; of the whole text if it is no longer than one; 0 without tokens."""

    def of(low: Column) -> Column:
        n = F.size(low)
        begins = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
        ratios = F.transform(begins, lambda i: F.size(F.array_distinct(F.slice(low, i + 1, window))) / float(window))
        mean = bound(ratios, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.size(r))
        return F.when(n <= window, F.size(F.array_distinct(low)) / F.greatest(n, F.lit(1))).otherwise(mean)

    return bound(F.transform(words, F.lower), of)


#: Names of the surface features.
FEATURES = (
    "mean_sentence_length", "numeric_rate", "has_statistic", "hedge_rate", "first_person_rate", "moving_ttr", "mean_word_length", "acronym_rate",
    "passive_per_sentence", "word_count",
)


def features(text: Column) -> dict[str, Column]:
    """All surface features, by name; rates are per token, with 1 as the least number of tokens or sentences."""
    words = tokens(text)
    n = F.size(words)
    alpha = F.filter(words, lambda w: w.rlike("^[A-Za-z]"))
    per_token = lambda c: c / F.greatest(n, F.lit(1))
    sentences = F.regexp_count(strip(text), F.lit(SENTENCE_BREAK)) + 1
    letters = F.aggregate(alpha, F.lit(0), lambda s, w: s + F.length(w))
    return {
        "word_count": word_count(text),
        "mean_sentence_length": F.greatest(n, F.lit(1)) / sentences,
        "numeric_rate": per_token(n - F.size(alpha)),
        "has_statistic": text.rlike(STATISTIC).cast("int"),
        "hedge_rate": per_token(F.regexp_count(text, F.lit(HEDGE))),
        "first_person_rate": per_token(F.regexp_count(text, F.lit(FIRST))),
        "moving_ttr": moving_ttr(words),
        "mean_word_length": letters / F.greatest(F.size(alpha), F.lit(1)),
        "acronym_rate": per_token(F.regexp_count(text, F.lit(ACRONYM))),
        "passive_per_sentence": F.regexp_count(text, F.lit(PASSIVE)) / sentences,
    }
