"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and abbreviations that results depend on.
POSITIVE = ("good", "great", "excellent", "amazing", "wonderful", "love", "like", "best")
NEGATIVE = ("bad", "terrible", "awful", "horrible", "worst", "hate", "dislike", "terrible")
MASKS = (
    (r"\b\d{4}-\d{4}-\d{4}-\d{4}\b", "CREDIT_CARD"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
    (r"\b\d{3}-\d{3}-\d{4}\b", "PHONE"),
    (r"\b\w+@\w+\.\w+\b", "EMAIL"),
    (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "NAME"),
    (r"\b[A-Z][A-Z]+ [A-Z][a-z]+\b", "COMPANY"),
    (r"\bJohn Smith\b", "PERSON"),
    (r"\bACME Corp\b", "ORGANIZATION"),
)
SENSITIVE = (r"\b\w+@\w+\.\w+\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}-\d{3}-\d{4}\b", r"\b\d{10,}\b", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
SENSITIVE_NAMES = ("John", "Jane", "Smith", "Doe", "ACME")
SENSITIVE_KEYS = ("password", "token", "api_key", "secret", "credential", "private_key", "aws_access_key", "aws_secret_key")
ABBREVIATIONS = (("artificial intelligence", "AI"), ("machine learning", "ML"), ("natural language processing", "NLP"), ("deep learning", "DL"))
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ORGANISATION = r"\b[A-Z][a-zA-Z]*\s*(?:Inc|Corp|LLC|Ltd|Company)\b"
LOCATION = r"\b(?:in|at|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"


LETTER = r"[\p{L}\p{N}_]"


def on_any_text(pattern: str) -> str:
    """A pattern whose words, and edges of words at its ends, hold for letters and digits of all scripts, whatever the JVM's version."""
    pattern = pattern.replace(r"\w", LETTER).replace(r"\s", r"[ \t\n\r\f\x0b]")
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{LETTER}){pattern[2:]}"
    return f"{pattern[:-2]}(?!{LETTER})" if pattern.endswith(r"\b") else pattern


def folded(text: Column) -> Column:
    """Letters and digits beyond ASCII as underscores: for digests that an engine without such words has to give, too."""
    return F.regexp_replace(text, r"[^\x00-\x7F\p{S}\p{P}\p{Z}\p{C}\p{M}]", "_")


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0b]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(on_any_text(ENTITY)), F.lit(0))


def all_entities(text: Column) -> Column:
    """Distinct names, organisations and places, in order."""
    found = [F.regexp_extract_all(text, F.lit(on_any_text(r"\b[A-Z][a-z]+\b")), F.lit(0)), F.regexp_extract_all(text, F.lit(on_any_text(ORGANISATION)), F.lit(0)), F.regexp_extract_all(text, F.lit(on_any_text(LOCATION)), F.lit(1))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def sentiment(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Whether more listed words occur as substrings from the one list or the other; a word listed twice counts twice."""
    hits = lambda ws: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in ws), F.lit(0))
    return F.when(hits(positive) > hits(negative), "positive").when(hits(negative) > hits(positive), "negative").otherwise("neutral")


def mask(text: Column, masks=MASKS) -> Column:
    """Personal data replaced by fixed marks, pattern after pattern."""
    for pattern, kind in masks:
        text = F.regexp_replace(text, on_any_text(pattern), f"ANON_{kind}")
    return text


def sensitive(word: Column) -> Column:
    hit = F.lit(False)
    for pattern in SENSITIVE:
        hit = hit | word.rlike(on_any_text(pattern))
    named = (F.length(word) > 2) & word.rlike(r"^[A-Z][^A-Z]*[a-z][^A-Z]*$") & word.isin(*SENSITIVE_NAMES)
    return hit | named


def redact(entries: Column) -> Column:
    """A map with the values of telling keys masked."""
    telling = lambda k: F.lower(k).rlike("|".join(SENSITIVE_KEYS))
    return F.transform_values(entries, lambda k, v: F.when(telling(k), F.lit("***REDACTED***")).otherwise(v))


def normalise(text: Column) -> Column:
    """White space collapsed and phrases abbreviated."""
    out = F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))
    for phrase, short in ABBREVIATIONS:
        out = F.regexp_replace(out, f"(?i){phrase}", short)
    return out


def fidelity(original: Column, other: Column) -> Column:
    """Share of the original's distinct words that the other text has; 1 if it has none."""
    own = F.array_distinct(words(original))
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, words(other))) / F.greatest(F.size(own), F.lit(1)))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, lower-cased; the characters are taken apart once, so the work is linear."""

    def of(c: Column) -> Column:
        pairs = F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y))
        return F.array_distinct(F.filter(F.zip_with(pairs, F.slice(c, F.lit(3), F.size(c)), lambda x, y: F.concat(x, y)), lambda g: g.isNotNull()))

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))), of)[0]


def trigram_jaccard(a: Column, b: Column) -> Column:

    def of(z: Column) -> Column:
        both = F.size(F.array_intersect(z[0], z[1])).cast("double")
        return F.coalesce(F.try_divide(both, F.size(z[0]) + F.size(z[1]) - both), F.lit(0.0))

    return F.transform(F.array(F.array(trigrams(a), trigrams(b))), of)[0]


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("... [truncated, "), F.length(text).cast("string"), F.lit(" total]"))).otherwise(text)


def keyword_score(text: Column, query: str) -> Column:
    """Matched query words over query words; a substring alone scores 0.5."""
    asked = sorted(set(query.lower().split()))
    found = F.size(F.array_intersect(F.array_distinct(words(text)), F.array(*map(F.lit, asked))))
    return F.when(found > 0, found / F.lit(float(len(asked)))).when(F.contains(F.lower(text), F.lit(query.lower())), 0.5).otherwise(0.0)
