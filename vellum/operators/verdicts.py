"""Reading predictions and reports: verdicts, review issues, tallies, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import keep_first

# Labels in a prediction, and the verdicts that need no review.
VERDICT, KIND, BASIS = r"(?U)판정\s*:\s*(\S+)", r"(?U)유형:\s*([^\n]+)", r"(?U)근거:\s*([\s\S]+)"
VERDICT_LINE = r"(?U)판정:\s*([^\n]+)"
SOUND = ("일치", "충족")
NO_RISK = "위험 조항 감지"
DOCUMENT_TYPES = ("rfp", "pep", "rpt")


def _found(s: Column, pattern: str) -> Column:
    return T.strip(F.regexp_extract(F.coalesce(s, F.lit("")), pattern, 1))


def has_relevant(refs: Column, least: float = 0.8) -> Column:
    """Whether an array of references ``(score, ...)`` has one with a score of ``least`` or more; null scores count as 0."""
    return F.coalesce(F.exists(refs, lambda x: F.coalesce(x["score"], F.lit(0.0)) >= least), F.lit(False))


def needs_review(prediction: Column) -> Column:
    """A prediction that isn't blank and whose verdict isn't a sound one; one without a readable verdict stays."""
    return (T.strip(F.coalesce(prediction, F.lit(""))) != "") & ~_found(prediction, VERDICT).isin(*SOUND)


def reading(raw: Column) -> Column:
    """``(verdict, kind, basis)`` of a stored prediction; the whole text is the basis where none is given."""
    basis = _found(raw, BASIS)
    return F.struct(_found(raw, VERDICT_LINE).alias("verdict"), _found(raw, KIND).alias("kind"), F.when(F.coalesce(raw, F.lit("")).rlike(BASIS), basis).otherwise(F.coalesce(raw, F.lit(""))).alias("basis"))


def review_issues(items: DataFrame, order: list[Column]) -> DataFrame:
    """``doc_id, location, original_text, issue, legal_ref``: the first item of each clause that needs review.

    ``items(doc_id, clause_number, clause_text, risk_names, prediction)``.
    """
    own = items.where(needs_review(F.col("prediction")))
    first = keep_first(own, ["doc_id", "clause_number"], order)
    names = F.coalesce(F.nullif(F.array_join("risk_names", ", "), F.lit("")), F.lit(NO_RISK))
    return first.select("doc_id", F.col("clause_number").alias("location"), F.substring("clause_text", 1, 300).alias("original_text"), names.alias("issue"), T.strip(F.col("prediction")).alias("legal_ref"))


def issue_counts(reports: DataFrame, groups: list[str]) -> DataFrame:
    """For each report the size of each of its issue arrays, and their sum."""
    sizes = {g: F.greatest(F.size(F.coalesce(F.col(g), F.array())), F.lit(0)) for g in groups}
    return reports.select("doc_id", *(v.alias(f"n_{g}") for g, v in sizes.items()), sum(sizes.values(), F.lit(0)).alias("n_issues"))


def level_tally(issues: DataFrame, key: str, level: str, levels: list[str]) -> DataFrame:
    """How many issues of each level a document has."""
    return issues.groupBy(key).agg(*(F.count_if(F.col(level) == x).alias(f"n_{x}") for x in levels))


def rule_payload(reports: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Reports with ``issue_count``, ``blocking_issue_count`` and ``info_issue_count`` (all that don't block); zeros without issues."""
    n = issues.groupBy(key).agg(F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "blocking").alias("blocking_issue_count"))
    n = n.withColumn("info_issue_count", F.col("issue_count") - F.col("blocking_issue_count"))
    return reports.join(n, key, "left").na.fill(0, ["issue_count", "blocking_issue_count", "info_issue_count"])


def issue_line(kind: Column, code: Column, title: Column, message: Column) -> Column:
    """``[kind] code / title: message``; a dash for what is missing, nothing for a missing message."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return F.concat(F.lit("["), dash(kind), F.lit("] "), dash(code), F.lit(" / "), dash(title), F.lit(": "), F.coalesce(message, F.lit("")))


def missing_items(content: Column, items: Column) -> Column:
    """The expected items that a content doesn't hold, empty ones left out, in order."""
    return F.filter(items, lambda x: (x != "") & ~F.coalesce(content, F.lit("")).contains(x))


def section_code(section_id: Column) -> Column:
    """``pep_03_01`` as ``PEP-03-01``."""
    return F.upper(F.replace(section_id, F.lit("_"), F.lit("-")))


def section_id(code: Column) -> Column:
    """``PEP-03-01`` as ``pep_03_01``."""
    return F.lower(F.replace(code, F.lit("-"), F.lit("_")))


def document_type(name: Column, text: Column, sections: Column, front: int = 2000, first: int = 5) -> Column:
    """The first of ``DOCUMENT_TYPES`` that the name, the text's front or the first sections' ids and titles hold; null if none does."""
    parts = F.array_join(F.slice(F.coalesce(sections, F.array().cast("array<string>")), 1, first), " ")
    hay = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, front), parts))
    return F.coalesce(*(F.when(hay.contains(t), t) for t in DOCUMENT_TYPES), F.lit(None).cast("string"))


def flat_content(content: Column) -> Column:
    """A section's content from JSON: a string as it is, an object's values line after line, anything else as text."""
    parsed = F.try_parse_json(content)
    values = F.from_json(content, "map<string,string>")
    body = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), T.strip(F.array_join(F.map_values(values), "\n")))
    return F.coalesce(body, F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")), content, F.lit(""))


def response_verdicts(responses: DataFrame, text: str) -> DataFrame:
    """How often each first line of a response occurs."""
    return responses.groupBy(T.strip(F.split_part(F.col(text), F.lit("\n"), F.lit(1))).alias("verdict")).agg(F.count("*").alias("n"))
