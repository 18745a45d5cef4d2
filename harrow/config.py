"""Job parameters: lexicons, field rules, limits.

Everything the mining job can be tuned with lives in one frozen dataclass so a
run is fully described by (tables, config, run_ts).  The lexicons are turned
into literal Spark expressions by the operators; nothing here is evaluated row
by row in Python.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Dict, List, Optional, Tuple

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced, so they are
# stated plainly, in their natural order.
# ---------------------------------------------------------------------------

HIGH_PRIORITY_KEYWORDS = [
    "short-term program", "short-term programme", "summer program", "summer programme",
    "inbound program", "inbound programme", "japanese language program",
    "japanese language programme", "customized program", "customised programme",
    "study abroad", "exchange program", "non-degree", "certificate",
    "application deadline", "program fee", "programme fee", "tuition", "housing",
    "accommodation", "eligibility",
]
LOW_PRIORITY_KEYWORDS = ["international students", "admissions", "campus life", "news", "events"]
URL_HINTS = [
    "short", "summer", "inbound", "japanese", "language", "custom", "exchange",
    "non-degree", "certificate", "program", "programme", "study-abroad", "international",
]
ACTION_TERMS = ["apply", "application", "deadline", "fee", "tuition", "eligibility"]
AVOID_URL_PARTS = [
    "/login", "signin", "auth", "wp-login", "logout", "contact", "inquiry",
    "calendar", "tag/", "category/", "author/", "share=", "?replytocom=",
]
NEGATIVE_URL_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".zip", ".doc", ".docx",
    ".ppt", ".pptx", ".xls", ".xlsx", ".css", ".js", ".mp4", ".mp3",
]
SKIP_SCHEMES = ["mailto:", "tel:", "javascript:"]
PROGRAMME_TYPES = [
    ("Summer Programme", ["summer program", "summer programme", "summer school"]),
    ("Short-term Programme", ["short-term", "short term"]),
    ("Exchange Programme", ["exchange program", "exchange programme"]),
    ("Japanese Language Programme", ["japanese language"]),
    ("Certificate Programme", ["certificate"]),
    ("Study Abroad Programme", ["study abroad"]),
]
# Field rules: label patterns in priority order; group 1 is the value.
FIELD_PATTERNS = {
    "target_students": [
        r"Target(?:ed)? (?:Students|Participants|Audience)[:\s]+([^.;\n]{3,180})",
        r"Eligibility[:\s]+([^.;\n]{3,180})",
    ],
    "duration_period": [r"Duration[:\s]+([^.;\n]{3,180})", r"Period[:\s]+([^.;\n]{3,180})"],
    "programme_dates": [
        r"(?:Program|Programme) Dates?[:\s]+([^.;\n]{3,180})",
        r"Dates?[:\s]+([^.;\n]{3,180})",
    ],
    "application_deadline": [
        r"Application Deadline[:\s]+([^.;\n]{3,180})",
        r"Deadline[:\s]+([^.;\n]{3,180})",
    ],
    "programme_fee": [
        r"(?:Program|Programme) Fee[:\s]+([^.;\n]{3,180})",
        r"Tuition[:\s]+([^.;\n]{3,180})",
        r"Fee[:\s]+([^.;\n]{3,180})",
    ],
    "credits_certificate": [r"(?:Credits?|Certificate)[:\s]+([^.;\n]{3,180})"],
    "main_contents": [r"(?:Overview|About|Contents?|Description)[:\s]+([^\n]{20,500})"],
    "eligibility": [r"Eligibility[:\s]+([^\n]{3,500})", r"Requirements?[:\s]+([^\n]{3,500})"],
}
LANGUAGE_WORDS = [("English", "English"), ("Japanese", "Japanese")]
HOUSING_WORDS = ["housing", "accommodation", "dormitory", "residence"]
NAME_SUFFIX_PATTERN = r"\s*[|–—-]\s*(.+University|Admissions|International.*)$"
MATCH_STRIP_CHARS = " :-–—"
MISSING_TOKENS = ["unknown", "n/a", "none"]
DUPLICATE_STOP_WORDS = ["program", "programme", "the", "and", "of"]
IMPORTANT_REVIEW_FIELDS = [
    "Programme Name", "Programme Dates", "Application Deadline", "Programme Fee",
    "Housing", "Eligibility", "Source URL",
]
FALLBACK_MISSING = ["Programme Dates", "Application Deadline", "Programme Fee", "Housing", "Eligibility"]
#: Name that robots rules are matched with; a job passes its own.
USER_AGENT = "harrow"
MALFORMED = "Invalid IPv6 URL"
INPUT_COLUMNS = ["University Name", "Country", "Seed URL", "Allowed Domain", "Notes"]
CANDIDATE_COLUMNS = [
    "University Name", "Country", "URL", "Page Title", "Candidate Score",
    "Matched Keywords", "Candidate Type", "Reason", "Needs Review",
]
PROGRAMME_COLUMNS = [
    "University Name", "Country", "Programme Name", "Programme Type",
    "Target Students", "Language", "Duration / Period", "Programme Dates",
    "Application Deadline", "Programme Fee", "Housing", "Credits / Certificate",
    "Main Contents", "Eligibility", "Source URL", "Source Page Title",
    "Confidence Score", "Missing Fields", "Review Status", "Duplicate Group",
    "Duplicate Status", "Last Checked", "Extraction Method", "Notes",
]
RUN_LOG_COLUMNS = [
    "Start Time", "End Time", "Universities Processed",
    "Universities With Candidates", "Universities With Extracted Programmes",
    "Total Pages Visited", "Total Candidate Pages", "Candidate Pages Read",
    "Total Programme Rows", "Fallback Rows", "Duplicate Rows", "Status",
    "Warnings", "Errors",
]
STRONG = ("Strong programme candidate", "High-priority programme keywords found.")
POSSIBLE = ("Possible related page", "Lower-priority keywords or URL hints found.")
LOW = ("Low relevance", "No configured candidate keywords found.")
INFERRED_NOTE = "Programme name inferred from page title, heading, or URL."
FALLBACK_NOTE = (
    "Fallback candidate row because no programme rows were extracted for this university. "
    "Programme name inferred from page title or URL."
)
HIGHLIGHT_COLOURS = [
    ("Likely valid", "E2F0D9"),
    ("Needs human review", "FFF2CC"),
    ("Low confidence", "FCE4D6"),
    ("Duplicate", "D9EAF7"),
]
# Weights and thresholds.
CRAWL_DEPTH_LIMIT = 2
MIN_CANDIDATE_SCORE = 20
HIGH_WEIGHT, LOW_WEIGHT, URL_WEIGHT, ACTION_BONUS = 15, 5, 3, 10
MIN_NAME_CHARS = 4
DUPLICATE_RATIO = 0.88
FALLBACK_CONFIDENCE_CAP = 45
MAX_PATH_SLASHES = 5
# Limits of a polite live crawl.  Over captured pages there are none unless a
# job asks for them: ``DEFAULT.with_(**CRAWL_LIMITS)``.
CRAWL_LIMITS = {
    "max_pages": 50, "score_text_chars": 10000, "match_chars": 500, "name_chars": 200, "fallback_top": 5, "warnings_kept": 20,
}


@dataclass(frozen=True)
class MiningConfig:
    high_keywords: List[str] = field(default_factory=lambda: list(HIGH_PRIORITY_KEYWORDS))
    low_keywords: List[str] = field(default_factory=lambda: list(LOW_PRIORITY_KEYWORDS))
    url_hints: List[str] = field(default_factory=lambda: list(URL_HINTS))
    action_terms: List[str] = field(default_factory=lambda: list(ACTION_TERMS))
    avoid_url_parts: List[str] = field(default_factory=lambda: list(AVOID_URL_PARTS))
    negative_extensions: List[str] = field(default_factory=lambda: list(NEGATIVE_URL_EXTENSIONS))
    skip_schemes: List[str] = field(default_factory=lambda: list(SKIP_SCHEMES))
    programme_types: List[Tuple[str, List[str]]] = field(default_factory=lambda: list(PROGRAMME_TYPES))
    field_patterns: Dict[str, List[str]] = field(default_factory=lambda: dict(FIELD_PATTERNS))
    language_words: List[Tuple[str, str]] = field(default_factory=lambda: list(LANGUAGE_WORDS))
    housing_words: List[str] = field(default_factory=lambda: list(HOUSING_WORDS))
    name_suffix_pattern: str = NAME_SUFFIX_PATTERN
    #: Links followed from the seed; None: until no new page is found.
    max_depth: Optional[int] = CRAWL_DEPTH_LIMIT
    #: Pages visited per target; None: all.
    max_pages: Optional[int] = None
    #: Characters of a page's text that are scored; None: all.
    score_text_chars: Optional[int] = None
    #: Characters kept of a field's value, and of a programme's name; None: all.
    match_chars: Optional[int] = None
    name_chars: Optional[int] = None
    min_score: int = MIN_CANDIDATE_SCORE
    duplicate_ratio: float = DUPLICATE_RATIO
    #: Fallback rows per target, and warnings in the run log's text; None: all.
    fallback_top: Optional[int] = None
    warnings_kept: Optional[int] = None
    user_agent: str = USER_AGENT

    def with_(self, **kw) -> "MiningConfig":
        return replace(self, **kw)


DEFAULT = MiningConfig()

# A lexicon whose terms occur in the driver's synthetic prose, so that every
# tier, every field rule and every review status is exercised on real tables.
# The rules (weights, thresholds, ordering) are the default ones.
TEST = MiningConfig(
    high_keywords=["of the", "at the", "with the", "for the"],
    low_keywords=["this", "that", "der "],
    url_hints=["blog", "/en/", "page=", ".html"],
    action_terms=["was", "are"],
    programme_types=[
        ("Summer Programme", ["with the", "summer school"]),
        ("Short-term Programme", ["der ", "short term"]),
        ("Exchange Programme", ["que "]),
        ("Certificate Programme", ["les "]),
    ],
    field_patterns={
        "target_students": [r"With[:\s]+([^.;\n]{3,180})", r"Of[:\s]+([^.;\n]{3,180})"],
        "duration_period": [r"Was[:\s]+([^.;\n]{3,180})"],
        "programme_dates": [r"(?:At|For) the[:\s]+([^.;\n]{3,180})", r"The[:\s]+([^.;\n]{3,180})"],
        "application_deadline": [r"Is[:\s]+([^.;\n]{3,180})"],
        "programme_fee": [r"Of the[:\s]+([^.;\n]{3,180})", r"Of[:\s]+([^.;\n]{3,180})"],
        "credits_certificate": [r"(?:Was|Were)[:\s]+([^.;\n]{3,180})"],
        "main_contents": [r"(?:And|The)[:\s]+([^\n]{20,500})"],
        "eligibility": [r"With the[:\s]+([^\n]{3,500})", r"Is[:\s]+([^\n]{3,500})"],
    },
    language_words=[("English", "the"), ("Japanese", "que")],
    housing_words=["was", "les"],
)
