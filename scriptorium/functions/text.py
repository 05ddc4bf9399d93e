"""Text columns: keys, accents, similarity, n-grams, classification, extraction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
# Values that decide results: patterns, labels, thresholds.

UNIVERSITY_REGEX = (
    "(?i)(universit|hochschule|polytechnic|politecnico|institute of technology|大学|대학)"
)

RESPONDENT = "enquêté"
LOGGED = "loggé"
ANONYMOUS_USERS = ("survey", "[survey respondent]", "")
HEX32_REGEX = "(?i)^[0-9a-f]{32}$"

ACTION_OTHER = "Autre"
#: First match wins, on the lower-cased text without accents.
ACTION_PATTERNS = (
    (
        "Authentification",
        r"\blogin\b|\blogout\b|connexion|deconnexion|authentif|password|mot de passe|2fa|mfa",
    ),
    ("API", r"\bapi\b|web service"),
    ("Utilisateurs", r"user|utilisateur|role|rights?|permission|privilege|droit"),
    ("Projet", r"project|projet|design|conception|settings?|parametr|instrument"),
    (
        "Questionnaires",
        r"survey|enquete|participant|reponse|questionnaire|alerte|invitation",
    ),
    ("Fichiers", r"download|upload|document|fichier|file repository|signature"),
    (
        "Enregistrements",
        r"record|enregistrement|save|create|delete|import|export|mettre a jour|mise a jour"
        r"|update|creer|supprimer|verrouiller|deverrouiller|lock|unlock",
    ),
)

#: Respondent identifiers inside an action, by priority.
RESPONDENT_PATTERNS = (
    r"reponse\s+(?:mise\s+a\s+jour|creee?|created|updated)\s+([a-z0-9-]+)",
    r"\benreg\.\s*([a-z0-9-]+)",
    r"enregistrement\s+([a-z0-9-]+)",
)

DOI_REGEX = r"\b10\.\d{4,}/[^\s\"'<>,;]+"
EMAIL_MAX_LENGTH = 254
EMAIL_REGEX = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+"
    r"@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)
HEX_REGEX = r"^[0-9a-fA-F]+$"
ORCID_REGEX = r"^(https://orcid\.org/)?\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"

SEGMENT_MIN_CHARS = 20
SEGMENT_LONG_LINE = 500
SEGMENT_WINDOW = 200
SEGMENT_STEP = 80
# -------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters that decompose into one base letter plus marks, and those base letters."""
    accented, plain = [], []
    for code in range(0xA0, 0xFFFF):
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if len(decomposed) < 2 or unicodedata.combining(decomposed[0]):
            continue
        if all(unicodedata.category(mark) == "Mn" for mark in decomposed[1:]):
            accented.append(char)
            plain.append(decomposed[0])
    return "".join(accented), "".join(plain)


def fold_accents(text: Column) -> Column:
    """Drop diacritics: precomposed letters become their base, loose marks vanish.

    Letters without a decomposition (``ß œ æ ø ł``) stay.
    """
    accented, plain = accent_table()
    folded_text = F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded_text).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case without accents, the form classification patterns expect."""
    return fold_accents(F.lower(text))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def match_key(name: Column) -> Column:
    """Name key for exact matching: lower, no accents, ``[a-z0-9]`` words, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(name)), "[^a-z0-9]+", " "))


def normalize_string(
    text: Column,
    *,
    accents: bool = True,
    punctuation: bool = True,
    whitespace: bool = True,
    lower: bool = True,
) -> Column:
    """Comparable form of a string; each switch turns one step off.

    Punctuation removal keeps letters, digits, white space, ``_`` and ``-``.
    """
    out = fold_accents(text) if accents else text
    if punctuation:
        out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}\s_-]", "")
    if whitespace:
        out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.lower(out) if lower else out


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - levenshtein / longest``; 1 for equal (also two empty) strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def ngrams(text: Column, n: int) -> Column:
    """Distinct lower-case character n-grams; empty when the text is shorter than n."""

    def grams(low: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(
            F.length(low) >= n,
            F.array_distinct(F.transform(starts, lambda i: low.substr(i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    return _with(F.lower(text), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays without duplicates; 1 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(a, b))), F.lit(1.0))


def weighted_mean(values: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Mean of columns, or their weighted mean when one weight per value is given."""
    if weights is not None and len(weights) == len(values):
        total = sum(weights) or 1.0
        terms = [value * (weight / total) for value, weight in zip(values, weights)]
        return sum(terms[1:], terms[0])
    return sum(values[1:], values[0]) / len(values)


def ngram_similarity(
    a: Column, b: Column, sizes: Sequence[int] = (2, 3), weights: Sequence[float] | None = None
) -> Column:
    """Mean (or weighted mean) of the n-gram Jaccard indices; 1 for equal strings."""
    score = weighted_mean([jaccard(ngrams(a, n), ngrams(b, n)) for n in sizes], weights)
    return F.when(a == b, F.lit(1.0)).otherwise(score)


def split_orgs(field: Column) -> Column:
    """``name,offset;name,offset`` to distinct names in order.

    Only the last ``,digits`` of an entry is the offset: inner commas stay.
    """
    names = F.transform(
        F.split(field, ";"), lambda entry: F.trim(F.regexp_replace(F.trim(entry), r",\d+$", ""))
    )
    return F.array_distinct(F.filter(names, lambda name: name != ""))


def looks_university(name: Column, pattern: str = UNIVERSITY_REGEX) -> Column:
    """Does a name look like a university, in several languages."""
    return name.rlike(pattern)


def bare_id(identifier: Column) -> Column:
    """Last path segment of a registry or entity URI; empty for null or blank."""
    return F.coalesce(F.regexp_extract(F.trim(identifier), "([^/]+)/*$", 1), F.lit(""))


def user_type(username: Column) -> Column:
    """Respondent for anonymous names and 32-digit hexadecimal ids, else logged in."""
    anonymous = F.lower(username).isin(*ANONYMOUS_USERS)
    return F.when(anonymous | username.rlike(HEX32_REGEX), F.lit(RESPONDENT)).otherwise(
        F.lit(LOGGED)
    )


def action_category(action: Column) -> Column:
    """One of eight activity classes, by the first pattern that matches."""

    def classify(text: Column) -> Column:
        out = F.lit(ACTION_OTHER)
        for label, pattern in reversed(ACTION_PATTERNS):
            out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
        return out

    return _with(folded(action), classify)


def respondent_id(action: Column, username: Column) -> Column:
    """Respondent named by the action, else ``user:<name>``."""

    def named(text: Column) -> Column:
        return F.coalesce(
            *[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in RESPONDENT_PATTERNS]
        )

    return F.coalesce(_with(folded(action), named), F.concat(F.lit("user:"), username))


def extract_dois(text: Column) -> Column:
    """Distinct lower-case DOIs of a text, in order, without trailing ``.`` or ``)``."""
    found = F.regexp_extract_all(text, F.lit(DOI_REGEX), 0)
    return F.array_distinct(F.transform(found, lambda doi: _trim_doi(F.lower(doi))))


def normalize_doi(doi: Column) -> Column:
    """Bare lower-case DOI: resolver prefix and trailing ``.`` or ``)`` removed."""
    return _trim_doi(F.regexp_replace(F.lower(doi), "^https?://doi\\.org/", ""))


def _trim_doi(doi: Column) -> Column:
    return F.regexp_replace(doi, r"[.)]+$", "")


def valid_email(text: Column) -> Column:
    return F.length(text).between(1, EMAIL_MAX_LENGTH) & text.rlike(EMAIL_REGEX)


def valid_hex(text: Column) -> Column:
    return text.rlike(HEX_REGEX)


def valid_orcid(text: Column) -> Column:
    return text.rlike(ORCID_REGEX)


def segments(text: Column) -> Column:
    """Candidate reference lines: trimmed lines over 20 characters.

    A line over 500 characters is cut into windows of 200 every 80; the last window
    ends at the end of the line.
    """
    lines = F.filter(
        F.transform(F.split(text, "\r?\n"), lambda line: F.trim(line)),
        lambda line: F.length(line) > SEGMENT_MIN_CHARS,
    )

    def windows(line: Column) -> Column:
        room = F.length(line) - SEGMENT_WINDOW
        last = F.ceil(room / SEGMENT_STEP).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: line.substr(F.least(i * SEGMENT_STEP, room) + 1, F.lit(SEGMENT_WINDOW)),
        )

    return F.flatten(
        F.transform(
            lines,
            lambda line: F.when(F.length(line) > SEGMENT_LONG_LINE, windows(line)).otherwise(
                F.array(line)
            ),
        )
    )
