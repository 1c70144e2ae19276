"""Text functions in column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is trimmed from a word's ends.
TRIMMED = ".,;:!?\"'()-[]{}…–—"
#: The phrases of which one must be in a text of each basis.
MARKERS = {
    "deduction": (
        "if ", "therefore", " then ", "because", "follows from", "implies", "entails", "consequently", "hence", "thus", "given that", "it follows",
    ),
    "empirical": (
        "i saw", "i observed", "i measured", "i tested", "i tried", "we saw", "we observed", "we measured", "we tested", "we tried", "we ran", "i ran",
        "observed", "measured", "noticed", "in our experiment", "in our test", "empirically",
    ),
    "convention": (
        "we use", "we track", "we follow", "we require", "this project", "the project uses", "this team", "our workflow", "our convention", "agents should",
        "agents must", "must use", "must be", "required to", "by convention", "the convention is", "standard practice",
    ),
}
#: Bases from the strongest.
BASIS_ORDER = ("research", "empirical", "definition", "convention", "deduction", "analogy", "llm_output", "vibes", "assumption")


def long_words(text: Column, n: int = 4) -> Column:
    """A text's lower-cased, trimmed words of ``n`` characters or more."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(TRIMMED)))
    return F.filter(words, lambda w: F.char_length(w) >= n)


def ngrams(text: Column, n: int = 4) -> Column:
    """The distinct character n-grams of a text's lower-cased, trimmed words."""
    long = long_words(text, n)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))))


def word_bag(text: Column, n: int = 4) -> Column:
    """The distinct words that a text's n-grams are of, between blanks; it has the same n-grams, in a third of the room of their hashes or less."""
    return F.array_join(F.array_sort(F.array_distinct(long_words(text, n))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)")))


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def basis_rank(basis: Column) -> Column:
    out = F.lit(len(BASIS_ORDER))
    for i, name in enumerate(BASIS_ORDER):
        out = F.when(basis == name, i).otherwise(out)
    return out


def validated_basis(basis: Column, source: Column, text: Column, transcript: Column) -> Column:
    """``struct(basis, source)``: research needs a source with a word in the transcript, three other bases a phrase."""
    heard = F.lower(transcript)
    words = F.transform(F.split(F.lower(source), r"\s+"), lambda w: F.btrim(w, F.lit(".,;:!?\"'()-[]")))
    grounded = F.exists(words, lambda w: (F.octet_length(w) > 3) & F.contains(heard, w))
    low, empty = F.lower(text), F.coalesce(source, F.lit("")) == ""
    research = basis == "research"
    new = F.when(research & (empty | ~grounded), "llm_output")
    for name, phrases in MARKERS.items():
        new = new.when((basis == name) & ~has_any(low, phrases), "vibes")
    return F.struct(new.otherwise(basis).alias("basis"), F.when(research & ~empty & ~grounded, "").otherwise(source).alias("source"))


def coerced_basis(basis: Column, speaker: Column) -> Column:
    told = F.lower(F.trim(basis))
    return F.when(told.isin(*BASIS_ORDER), told).otherwise(F.when(speaker == "assistant", "llm_output").otherwise("vibes"))


def document_source(path: Column, headings: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(F.size(headings) > 0, F.concat(base, F.lit("#"), F.array_join(headings, "/"))).otherwise(base)


def document_session(path: Column) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(path, 256), 1, 12))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def template_index(text: Column, templates: int) -> Column:
    """Which of ``templates`` a text takes: its hash's first eight bytes, modulo."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % templates).cast("int")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def verify_key(text: Column) -> Column:
    """The key under which a text's check is kept: the hash of its composed, case-folded words."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))

    return F.substring(F.sha2(folded(text), 256), 1, 24)


def query_text(text: Column, most: int = 200) -> Column:
    """What to search for: a text's words within ``most`` bytes, without a character that the cut would break."""
    bare = F.trim(F.regexp_replace(text, r"[\s\x{85}\x{A0}]+", " "))
    cut = F.make_valid_utf8(F.substring(F.encode(bare, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(bare) <= most, bare).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def flattened_messages(messages: Column) -> Column:
    """An array of ``(role, content)`` as one string that equal arrays alone share."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":\x1f"), m["content"], F.lit("\x1e"))), "")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def quoted_text(text: Column) -> Column:
    """What stands in the first quotation marks, without closing dots; the whole text if there are none."""
    inside = F.regexp_extract(text, '(?s)^[^"]*"([^"]*)', 1)
    closed = F.regexp_like(text, F.lit('(?s)^[^"]*"[^"]*"'))
    return F.when(~F.contains(text, F.lit('"')), text).when(closed, F.regexp_replace(inside, r"\.\.\.$", "")).otherwise(inside)


def compact_source(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https://", ""), "^http://", ""), "/$", "")
    bare = F.regexp_replace(bare, r"(?s)\?.*$", "")
    return F.when(F.char_length(bare) > 60, F.concat(F.substring(bare, 1, 57), F.lit("..."))).otherwise(bare)


def cut_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut before a word, with dots."""
    # the last white space at or before the cut, else the cut itself
    head = F.substring(text, 1, most + 1)
    at_space = F.regexp_extract(head, r"(?s)^(.+)\s\S*$", 1)
    cut = F.when(at_space != "", at_space).otherwise(F.substring(text, 1, most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("...")))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def verdict(reply: Column) -> Column:
    """The only verdict token of a reply, else null."""
    found = F.regexp_extract_all(reply, F.lit(r"(?i)(?<![A-Za-z0-9_])(ACTED_ON|AMBIGUOUS|IGNORED)(?![A-Za-z0-9_])"))
    return F.when(F.size(found) == 1, F.upper(F.get(found, 0)))


def sentences(text: Column) -> Column:
    """A text cut after each full stop, exclamation or question mark that white space follows."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def safe_project(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), "[^a-zA-Z0-9_-]", "")
    return F.when(bare == "", "default").otherwise(bare)


def reminder_wrapped(finding: Column, message: Column) -> Column:
    """A message with a finding before it, in the fence that marks what the system adds."""
    # fixed value: the fence
    return F.concat(F.lit("<system-reminder>\n"), F.trim(finding), F.lit("\n</system-reminder>\n\n"), F.trim(message))
