"""Whether a record must stay on this machine, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics of what must stay (fixed values).
TOPICS = (
    "health", "cc-health", "medication", "medical", "symptoms", "wellbeing", "finance", "cc-finance", "money", "spending", "budget", "banking", "tax",
    "salary", "insurance",
)
#: Sections of what must stay (a fixed value).
SECTION = r"(?i)health|medical|finance|money|life context"
#: Words of what must stay (a fixed value).
TEXT = r"(?i)\b(symptoms?|medications?|medicine|prescri\w*|diagnos\w*|doctors?|GP|blood (test|sugar|pressure)|fasting|metformin|illness|sick|injur\w*|allerg\w*|salary|payslip|bank account|mortgage|loans?|credit card|tax return|superannuation|net worth|savings)\b"


def sensitive_reason(topics: Column, section: Column, content: Column, extra: tuple[str, ...] = ()) -> Column:
    """The first reason by topic, section or text; null if there is none."""
    blocked = F.array(*[F.lit(t.lower()) for t in (*TOPICS, *extra)])
    topic = F.try_element_at(F.filter(topics, lambda t: F.array_contains(blocked, F.lower(t))), F.lit(1))
    word = F.nullif(F.lower(F.regexp_extract(content, TEXT, 0)), F.lit(""))
    return F.coalesce(
        F.when(topic.isNotNull(), F.concat(F.lit("topic:"), topic)),
        F.when(section.rlike(SECTION), F.concat(F.lit("section:"), section)),
        F.when(word.isNotNull(), F.concat(F.lit("text:"), word)),
    )
