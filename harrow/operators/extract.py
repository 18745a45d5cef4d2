"""Programme rows: name, field rules, review grading, fallback rows.

Every rule is a native expression: ordered regex rules are extracted once each,
in their order, until one finds something (that wins, even if it strips to
nothing), labels keep Python's Unicode case-insensitivity through Java's
``(?iu)`` flags, and whole-word tests use explicit letter/digit look-arounds.

A rule can only match where its label stands.  The letters that every match of a
rule has to hold (its *anchors*) are read off the rule, and sought as plain text in the
folded page text; only rules with an anchor there run their expression.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.urls import path_tail

JAVA_FLAGS = "(?iu)"


#: The letters beside A to Z that a case-insensitive match takes for a letter from a to z, and that letter.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def folded(text: Column) -> Column:
    """Lower-case text in which the anchors of case-insensitive rules are sought."""
    return F.lower(F.when(T.contains_any(text, FOLDED[0]), F.translate(text, *FOLDED)).otherwise(text))


def _longest(sequence) -> tuple[str, ...]:
    """Texts one of which is in every match of a parsed sequence: those whose shortest is longest; none if there are none."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*sequence, (None, None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        found.append((run,) if run else ())
        run = ""
        if name == "SUBPATTERN":
            found.append(_longest(arg[-1]))
        elif name == "BRANCH":
            ways = [_longest(way) for way in arg[1]]
            found.append(tuple(x for way in ways for x in way) if all(ways) else ())
        elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found.append(_longest(arg[2]))
    return max(found, key=lambda f: min(map(len, f), default=0))


@lru_cache(maxsize=1000)
def anchors(pattern: str) -> tuple[str, ...]:
    """Lower-case texts one of which every match of ``pattern`` holds; empty where that can't be told."""
    try:
        return _longest(re._parser.parse(pattern))
    except (re.error, AttributeError):
        return ()


def _extracted(text: Column, low: Column, pattern: str) -> Column:
    value = F.regexp_extract(text, JAVA_FLAGS + pattern, 1)
    near = anchors(pattern)
    return F.nullif(F.when(T.contains_any(low, near), value) if near else value, F.lit(""))


def first_letter(pattern: str) -> str:
    """The ASCII letter that every match of ``pattern`` begins with, in either case; empty where that can't be told."""
    try:
        (op, arg), *_ = [*re._parser.parse(pattern), (None, None)]
    except (re.error, AttributeError):
        return ""
    return chr(arg) if str(op) == "LITERAL" and chr(arg).isascii() and chr(arg).isalpha() else ""


def first_match(text: Column, patterns, chars: int | None = None, low: Column | None = None) -> Column:
    """Group 1 of the first pattern that finds one, cleaned; ``Unknown`` if none does.

    ``low`` is the folded text, where several calls share it.
    """
    if not patterns:
        return F.lit("Unknown")
    raw = F.coalesce(*[_extracted(text, folded(text) if low is None else low, p) for p in patterns])
    value = T.strip_chars(F.regexp_replace(raw, rf"{T.JAVA_WS}+", " "), C.MATCH_STRIP_CHARS)
    return F.coalesce(T.clipped(value, chars), F.lit("Unknown"))


def whole_word(text: Column, words, low: Column | None = None) -> Column:
    """Whether one of the words (expressions) stands in the text; they are sought as plain text first where they are plain."""
    alt = "|".join(words)
    # A look at the next letter is cheaper than one behind.
    begins = [first_letter(w) for w in words]
    ahead = f"(?=[{''.join(sorted(set(begins)))}])" if words and all(begins) else ""
    found = text.rlike(rf"(?iu){ahead}(?<![\p{{L}}\p{{N}}_])(?:{alt})(?![\p{{L}}\p{{N}}_])")
    near = [anchors(w) for w in words]
    if not all(near):
        return found
    return F.when(T.contains_any(folded(text) if low is None else low, [x for n in near for x in n]), found).otherwise(F.lit(False))


def language(text: Column, cfg: C.MiningConfig, low: Column | None = None) -> Column:
    out = F.lit("Unknown")
    for label, word in reversed(cfg.language_words):
        out = F.when(whole_word(text, [word], low), F.lit(label)).otherwise(out)
    return out


def housing(text: Column, cfg: C.MiningConfig, low: Column | None = None) -> Column:
    return F.when(whole_word(text, cfg.housing_words, low), F.lit("Available")).otherwise(F.lit("Unknown"))


def programme_type(text: Column, url: Column, cfg: C.MiningConfig) -> Column:
    def body(hay):
        out = F.lit("Unknown")
        for label, terms in reversed(cfg.programme_types):
            out = F.when(T.contains_any(hay, terms), F.lit(label)).otherwise(out)
        return out
    return T.let(F.lower(F.concat_ws(" ", text, url)), body)


def clean_name(value: Column, cfg: C.MiningConfig) -> Column:
    """Cut a trailing ``sep + ...University | Admissions | International...``."""
    return T.ustrip(F.regexp_replace(value, "(?iUd)" + cfg.name_suffix_pattern, ""))


def url_name(url: Column) -> Column:
    """Last path segment, ``-``/``_`` runs -> space, title-cased."""
    return T.title_case(T.ustrip(F.regexp_replace(path_tail(url), "[-_]+", " ")))


def infer_name(title: Column, heading: Column, url: Column, cfg: C.MiningConfig) -> Column:
    """``struct(name, inferred)``: heading, then title, then URL tail."""
    def pick(h, t):
        from_url = T.let(url_name(url), lambda n: F.when(n != "", n).otherwise(F.lit("Unknown Programme")))
        return F.when(F.length(h) >= C.MIN_NAME_CHARS, F.struct(T.clipped(h, cfg.name_chars).alias("name"),
                                                                 F.lit(False).alias("inferred"))) \
            .when(F.length(t) >= C.MIN_NAME_CHARS, F.struct(T.clipped(t, cfg.name_chars).alias("name"),
                                                             F.lit(True).alias("inferred"))) \
            .otherwise(F.struct(from_url.alias("name"), F.lit(True).alias("inferred")))
    return T.let(clean_name(F.coalesce(heading, F.lit("")), cfg),
                 lambda h: T.let(clean_name(F.coalesce(title, F.lit("")), cfg), lambda t: pick(h, t)))


FIELD_ORDER = ["target_students", "duration_period", "programme_dates", "application_deadline",
               "programme_fee", "credits_certificate", "main_contents", "eligibility"]
PROGRAMME_OUT = [
    "target_idx", "university_name", "country", "programme_name", "programme_type", "target_students",
    "language", "duration_period", "programme_dates", "application_deadline", "programme_fee", "housing",
    "credits_certificate", "main_contents", "eligibility", "source_url", "source_page_title",
    "confidence_score", "missing_fields", "review_status", "duplicate_group", "duplicate_status",
    "last_checked", "extraction_method", "notes", "candidate_rank",
]


def extract_programmes(cands: DataFrame, cfg: C.MiningConfig, run_date: Column) -> DataFrame:
    """Heuristic rows for candidates whose second read returned HTML.

    ``cands`` carries the candidate columns (``url, page_title, candidate_score,
    candidate_rank, target_idx, university_name, country``) and the detail read
    (``detail_title, detail_heading, detail_text, detail_has_html``).
    """
    d = cands.filter(F.col("detail_has_html"))
    d = d.withColumn("_title", F.when(F.col("detail_title") != "", F.col("detail_title")).otherwise(F.col("page_title")))
    d = d.withColumn("_name", infer_name(F.col("_title"), F.col("detail_heading"), F.col("url"), cfg))
    text, low = F.col("detail_text"), F.col("_low")
    d = d.withColumn("_low", folded(text))
    fields = {f: first_match(text, cfg.field_patterns.get(f, []), cfg.match_chars, low) for f in FIELD_ORDER}
    d = d.select(
        "*",
        programme_type(text, F.col("url"), cfg).alias("programme_type"),
        language(text, cfg, low).alias("language"),
        housing(text, cfg, low).alias("housing"),
        *[fields[f].alias(f) for f in FIELD_ORDER],
        T.count_contained(F.lower(text), cfg.high_keywords).alias("_kw"),
    )
    review = [
        ("Programme Name", F.col("_name.name")), ("Programme Dates", F.col("programme_dates")),
        ("Application Deadline", F.col("application_deadline")), ("Programme Fee", F.col("programme_fee")),
        ("Housing", F.col("housing")), ("Eligibility", F.col("eligibility")), ("Source URL", F.col("url")),
    ]
    missing = F.array_compact(F.array(*[F.when(T.is_missing(c), F.lit(n)) for n, c in review]))
    d = d.withColumn("_missing", missing).withColumn("_present", F.lit(len(review)) - F.size("_missing"))
    inferred = F.col("_name.inferred")
    score = F.col("candidate_score")
    confidence = F.least(F.lit(100), F.greatest(F.lit(0), score + F.when(inferred, -8).otherwise(12)
                                                 + F.col("_present") * 8 + F.least(F.lit(10), F.col("_kw") * 2)))
    status = (F.when((score < cfg.min_score) | ((F.col("_present") <= 2) & (F.col("_kw") <= 1)), F.lit("Low confidence"))
              .when((F.col("url") != "") & inferred & (F.size("_missing") > 0), F.lit("Needs human review"))
              .when((F.col("_name.name") != "") & (F.col("url") != "") & (F.col("_present") >= 5), F.lit("Likely valid"))
              .otherwise(F.lit("Needs human review")))
    return d.select(
        "target_idx", "university_name", "country",
        F.col("_name.name").alias("programme_name"), "programme_type", "target_students", "language",
        "duration_period", "programme_dates", "application_deadline", "programme_fee", "housing",
        "credits_certificate", "main_contents", "eligibility",
        F.col("url").alias("source_url"), F.col("_title").alias("source_page_title"),
        confidence.cast("int").alias("confidence_score"),
        F.array_join("_missing", ", ").alias("missing_fields"),
        status.alias("review_status"),
        F.lit("").alias("duplicate_group"), F.lit("Unique").alias("duplicate_status"),
        run_date.alias("last_checked"), F.lit("heuristic").alias("extraction_method"),
        F.when(inferred, F.lit(C.INFERRED_NOTE)).otherwise(F.lit("")).alias("notes"),
        "candidate_rank",
    )


def fallback_rows(cands: DataFrame, programmes: DataFrame, cfg: C.MiningConfig, run_date: Column) -> DataFrame:
    """Top candidates of targets that produced no heuristic row."""
    produced = programmes.select("target_idx").distinct()
    top = cands if cfg.fallback_top is None else cands.filter(F.col("candidate_rank") <= cfg.fallback_top)
    top = top.join(produced, "target_idx", "left_anti")
    name = infer_name(F.col("page_title"), F.lit(""), F.col("url"), cfg)
    unknown = F.lit("Unknown")
    return top.select(
        "target_idx", "university_name", "country",
        name["name"].alias("programme_name"),
        *[unknown.alias(c) for c in ["programme_type", "target_students", "language", "duration_period",
                                     "programme_dates", "application_deadline", "programme_fee", "housing",
                                     "credits_certificate", "main_contents", "eligibility"]],
        F.col("url").alias("source_url"), F.col("page_title").alias("source_page_title"),
        F.least(F.col("candidate_score"), F.lit(C.FALLBACK_CONFIDENCE_CAP)).cast("int").alias("confidence_score"),
        F.lit(", ".join(C.FALLBACK_MISSING)).alias("missing_fields"),
        F.lit("Needs human review").alias("review_status"),
        F.lit("").alias("duplicate_group"), F.lit("Unique").alias("duplicate_status"),
        run_date.alias("last_checked"), F.lit("fallback").alias("extraction_method"),
        F.lit(C.FALLBACK_NOTE).alias("notes"),
        "candidate_rank",
    )
