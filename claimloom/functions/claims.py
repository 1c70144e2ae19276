"""Column predicates and lookups over claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The claim model's bases by strength class, and what confidence each supports.
WEAK = ("vibes", "assumption", "llm_output")
STRONG = ("research", "empirical", "deduction", "definition", "convention")
CEILINGS = {
    "research": 0.95, "empirical": 0.95, "deduction": 0.95, "definition": 1.0, "convention": 1.0,
    "analogy": 0.7, "vibes": 0.5, "llm_output": 0.5, "assumption": 0.5,
}
RELATIONS = ("supports", "depends_on", "contradicts", "questions")
STRUCTURAL = ("supports", "depends_on")
PUSHBACK = ("contradicts", "questions")
#: Texts that report the status of work just done. ``\b`` and ``\s`` are ASCII.
STATUS_PATTERNS = (
    r"(?is)\btests?\b.{0,100}\b(pass(es|ed|ing)?|green|exist)\b",
    r"(?is)\b(build|lint|golangci-lint|go vet|gofmt|vet)\b.{0,20}\b(clean|green)\b",
    r"(?i)\bcame back (green|clean)\b",
    r"(?i)\bwas\s+(pushed|committed|tagged|merged|installed|created|updated|reordered|rewritten|flipped|renamed|deleted|added|made|auto-created)\b",
    r"(?i)\b(pushed to (main|origin)|tagged and pushed|pushed and tagged)\b",
    r"(?i)\bsmoke tests? (confirm|pass)",
    r"(?i)\bworks? end-to-end\b",
    r"(?is)\bCI\b.{0,30}\b(spinning|running|green|passing)\b",
    r"(?i)\b(cycle|process) completed\b",
)
#: A boundary between ASCII word characters and others; Java's own takes all letters for words.
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def status_pattern(pattern: str) -> str:
    """A pattern of ``STATUS_PATTERNS`` for Java's engine."""
    return pattern.replace(r"\b", _BOUNDARY).replace(r"\s", r"[\t\n\f\r ]")


def is_weak(basis: str | Column = "basis") -> Column:
    return (F.col(basis) if isinstance(basis, str) else basis).isin(*WEAK)


def is_strong(basis: str | Column = "basis") -> Column:
    return (F.col(basis) if isinstance(basis, str) else basis).isin(*STRONG)


def is_doc_origin() -> Column:
    return F.coalesce(F.col("session_id").startswith("doc:"), F.lit(False))


def is_stop_class() -> Column:
    return is_doc_origin() & is_weak()


def is_ephemeral(text: str = "text") -> Column:
    """Whether a text reports the status of work just done."""
    hit = F.lit(False)
    for pattern in STATUS_PATTERNS:
        hit = hit | F.rlike(F.col(text), F.lit(status_pattern(pattern)))
    return F.coalesce(hit, F.lit(False))


def confidence_ceiling() -> Column:
    out = F.lit(1.0)
    for basis, most in CEILINGS.items():
        out = F.when(F.col("basis") == basis, most).otherwise(out)
    return out


def sycophancy() -> Column:
    return F.col("grand_significance") | F.col("unique_connection") | F.col("dismisses_counterevidence")


def misrepresentation() -> Column:
    return F.col("ability_overstatement") | F.col("sentience_claim")


def moore_flagged() -> Column:
    """Any of the six flags that mark a session, without the announced action."""
    return sycophancy() | misrepresentation() | F.col("relational_drift")


def fits_cascade() -> Column:
    user = F.col("grand_significance") | F.col("sentience_claim") | F.col("relational_drift")
    by_speaker = F.when(F.col("speaker") == "assistant", moore_flagged()).when(F.col("speaker") == "user", user).otherwise(False)
    return ~F.col("closed") & ~F.col("challenged") & by_speaker


def inventory_flagged() -> Column:
    return moore_flagged() | F.col("consequential_action")


def is_recent(as_of: str, hours: int = 6, at: str = "created_at") -> Column:
    """No creation time, or one at most ``hours`` before ``as_of``."""
    return F.col(at).isNull() | F.expr(f"timestamp_ntz '{as_of}' - {at} <= interval '{hours}' hour")


def older_than(as_of: str, days: int, at: str) -> Column:
    return F.expr(f"timestamp_ntz '{as_of}' - {at} >= interval '{days}' day")


def truncated(text: str, n: int) -> Column:
    """At most ``n`` characters, the last three of a cut text being dots."""
    c = F.col(text)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def origin_tag() -> Column:
    """What a listing adds behind a claim from a document; empty for any other."""
    return F.when(is_doc_origin(), " [doc-origin]").otherwise("")
