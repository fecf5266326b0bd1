"""Labels, synonyms and keyword lists. They decide results and are kept in their original order."""

from __future__ import annotations

LABELS = ("Access", "Administrative rights", "HR Support", "Hardware", "Internal Project", "Miscellaneous", "Purchase", "Storage")
FALLBACK = "Miscellaneous"


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(";"))


# Synonyms by label; the order of labels and words is the order in which substrings are tried.
SYNONYMS: tuple[tuple[str, str], ...] = tuple(
    (word, label)
    for label, words in (
        ("Access", "access; login; log in; password; account; mfa; sso; otp; lockout; vpn"),
        ("Administrative rights", "administrative rights; admin rights; admin; administrator; admin role; role change; permission; permissions; privilege; entitlement; group membership; security group"),
        ("Hardware", "hardware; device; laptop; printer; monitor; dock; keyboard; mouse"),
        ("HR Support", "hr; hr support; hr_support; human resources; benefits; leave; vacation; payroll"),
        ("Purchase", "purchase; buy; order; invoice; billing; subscription; licence; license; renewal; quote; po; procurement; payment; refund"),
        ("Internal Project", "internal project; internal projects"),
        ("Storage", "storage"),
        ("Miscellaneous", "misc; miscellaneous; general; other"),
    )
    for word in _words(words)
)

# Keywords of the lexical prior.
PRIOR_KEYWORDS: dict[str, tuple[str, ...]] = {
    "Access": _words("access; login; log in; sign in; password; account; lockout; locked; sso; mfa; permission; permissions; role; group; entitlement; authorization; authorisation"),
    "Administrative rights": _words("admin; administrator; admin rights; admin access; elevated rights; elevated access; local admin; root; sudo; permission; privilege; entitlement; group membership; security group; access change; group change"),
    "Hardware": _words("laptop; computer; pc; desktop; printer; monitor; screen; keyboard; mouse; device; dock; docking station; headset; phone; hardware"),
    "HR Support": _words(
        "hr; human resources; payroll; paycheck; salary; compensation; bonus; wage; performance review; performance management; onboarding; offboarding; benefits; benefit enrollment; vacation; holiday request; "
        "leave request; leave; sickness; maternity; paternity; time off; pto; timesheet; attendance; hr portal; hr system; workday; sap hr; contract; employment status; probation; promotion; appraisal"
    ),
    "Purchase": _words(
        "purchase; buy; buying; order; invoice; billing; bill; subscription; licence; license; renewal; payment; quote; po; procurement; refund; vendor; supplier; cost centre; budget; statement; receipt; pricing; "
        "hardware purchase; software purchase"
    ),
    "Internal Project": _words("internal project; project work; initiative; internal program"),
    "Storage": _words("storage; quota; disk; drive; backup; archive; archival"),
    "Miscellaneous": _words("general; question; enquiry; inquiry; other; misc; miscellaneous"),
}
PRIOR_WEIGHTS = {"HR Support": 1.3, "Purchase": 1.2}

# Keywords of the heuristic scorer; a word listed twice counts twice.
SCORE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "Access": _words("login; password; account; mfa; otp; sso; lockout"),
    "Administrative rights": _words("admin; administrator; privilege; permission; role; rights; entitlement; group; security group"),
    "Hardware": _words("laptop; printer; dock; monitor; battery; device; keyboard; mouse; screen"),
    "HR Support": _words("benefit; benefits; leave; vacation; payroll; hr; human resources; salary; compensation; paternity; maternity; time off; pto"),
    "Miscellaneous": _words("misc; general; other"),
    "Purchase": _words("purchase; buy; order; invoice; procure; bill; subscription; license; licence; renew; payment; quote; po; vendor; supplier; procure; procurement; billing"),
    "Internal Project": _words("internal project; project work; initiative; internal program"),
    "Storage": _words("storage; quota; disk; drive; backup; archive"),
}

# Ordered keyword groups: the first group with a word in the text decides.
CATEGORY_GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Access", _words("login; log in; signin; sign in; password; credential; sso; mfa; otp; lockout; locked out; cannot access; access denied; access; account; auth")),
    ("Hardware", _words("laptop; printer; device; hardware; dock; monitor; screen; keyboard; mouse; pc; desktop; computer; headset")),
    ("Administrative rights", _words("admin; administrator; permission; privilege; rights; entitlement; group")),
    ("HR Support", _words("hr; benefit; leave; vacation; payroll")),
    ("Purchase", _words("buy; purchase; order; procure; invoice; billing; subscription; license; quote; po")),
    ("Internal Project", _words("internal project")),
    ("Storage", _words("storage; quota; disk")),
    ("Miscellaneous", _words("misc; general; other")),
)
TEXT_GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Access", _words("login; password; account; access; credential; mfa; sso")),
    ("Administrative rights", _words("admin; administrator; permission; privilege; rights; entitlement; role; group; security group")),
    ("Hardware", _words("laptop; printer; device; hardware; dock; keyboard; mouse; monitor; screen")),
    ("HR Support", _words("hr; benefit; leave; vacation; payroll")),
    ("Purchase", _words("buy; purchase; order; procure; invoice; billing; subscription; license; quote; po")),
    ("Internal Project", _words("internal project; project work")),
    ("Storage", _words("storage; quota; disk; drive")),
)
SHORT_GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("access", _words("vpn; network; password; login; access")),
    ("hr support", _words("hr; leave")),
    ("hardware", _words("printer; laptop; hardware")),
)

# Memory modes: older names and what they are called now.
LEGACY_MODES = {"rag": "rag_dense", "salience": "rag_hybrid"}
MEMORY_MODES = ("none", "rag_dense", "rag_bm25", "rag_hybrid")
CALIBRATION_EDGES = (0.0, 0.3, 0.5, 0.7, 0.9, 1.01)
COVERAGE_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9)
RESULT_COLUMNS: tuple[tuple[str, str], ...] = tuple(
    tuple(x.split())
    for x in _words(
        "router string; memory string; memory_mode string; model string; router_confidence_score double; router_decision_reason string; classifier_mode string; classifier_backend string; "
        "classifier_label string; classifier_confidence double; classifier_latency_ms double; classifier_token_cost double; classifier_accuracy double; classifier_efficiency_score double; "
        "ticket_id bigint; kb_attached boolean; result string; accuracy double; groundedness double; schema_validity double; latency_ms double; cost_usd double; retrieved_context_length bigint; "
        "retrieval_latency_ms double; memory_cost_tokens bigint; memory_relevance_score double; memory_context_used string; model_used string; json_valid boolean; schema_valid boolean; "
        "gold_category string; llm_category string; predicted_category string; classifier_metadata string"
    )
)
