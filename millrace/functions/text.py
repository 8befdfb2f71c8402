"""Text that leaves or steers: stripping values from outbound queries, spotting instructions aimed at a model, light stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.validators import bound
from millrace.operators.privacy import redacted

LONGEST, MOST_DIGITS = 300, 5

# What an outbound query must not carry, in the order it is taken out: quoted literals, marks of what has been
# redacted, groups of digits (telephone numbers), dates, amounts.
QUOTED = "'[^']*'|\"[^\"]*\"|`[^`]*`|“[^”]*”|‘[^’]*’"
VALUES = (r"\[redacted: [^\]]*\]", r"(?<![\w+])\+?[0-9]+(?:[ -][0-9]+){2,}\b", r"\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\b", r"\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b|\b[0-9]+\.[0-9]{2,}\b")

# Phrases that address a model rather than a reader, in English and Arabic, whatever the case.
INJECTIONS = (
    r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|your|these|the)\b[^.\n]{0,30}\b(instructions?|rules?|prompts?|guidelines?|directions?)\b",
    r"\bnew\s+(instructions?|rules?)\b[^.\n:]{0,25}:",
    r"\bfrom\s+now\s+on\b[^.\n]{0,40}\b(answer|reply|respond|only|always|you|ignore|skip)\b",
    r"\b(reveal|show|print|repeat|output|leak)\b[^.\n]{0,30}\b(system|hidden|initial)\s+(prompt|message|instructions?)\b",
    r"\byou\s+are\s+now\b[^.\n]{0,40}\b(an?|the|in)\b",
    r"\b(act|behave|respond)\s+as\s+(if\s+you\s+(are|were)|an?\s)",
    r"^\s*(system|assistant)\s*:",
    r"\b(system|assistant)\s*:\s*(call|ignore|you|reply|do|obey|run|now)\b",
    r"\b(call|invoke|run|execute)\b[^.\n]{0,30}\b(the\s+)?(tool|function)\b",
    r"\b(call|invoke|use)\s+(delete|drop|truncate|remove|approve|apply|grant|revoke)_[a-z_]+\b",
    r"\b(send|reveal|share|give|reply\s+with|tell)\b[^.\n]{0,40}\b(api\s+keys?|passwords?|credentials?|secrets?)\b",
    r"\b(delete|drop|truncate)\s+(the\s+)?(all\s+)?(tables?|data|rows)\b[^.\n]{0,30}\b(now|immediately|without)\b",
    r"\bdo\s+not\s+(tell|inform|mention|alert)\s+the\s+(user|member)\b",
    r"\b(send|post|forward|upload|exfiltrate)\b[^.\n]{0,60}\b(to|at)\s+https?://",
    r"</?\s*(system|instructions?)\s*>",
    r"تجاهل[^.\n]{0,30}(التعليمات|الأوامر|القواعد)",
    r"(انس|أهمل)[^.\n]{0,30}(التعليمات|الأوامر|القواعد)",
    r"(اكشف|اعرض|اطبع)[^.\n]{0,30}(التعليمات|الموجه)\s*(السابقة|الداخلية|الخاصة)?",
    r"(أنت|انت)\s+الآن\s",
    r"تعليمات\s+جديدة\s*:",
)

# Affixes that the Arabic stems lose, and the shortest stem.
AR_PREFIXES, AR_SUFFIXES, AR_STEM = "وال|بال|كال|فال|لل|ال|و", "ها|ان|ات|ون|ين|يه|ه|ي", 3


def stripped(query: Column) -> Column:
    """A search query without the values it may carry: concepts stay, short numbers too; LONGEST characters at most."""
    text = redacted(F.regexp_replace(query, QUOTED, " "))
    for pattern in VALUES:
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_count(w, F.lit("[0-9]")) <= MOST_DIGITS)
    return F.trim(F.substring(F.array_join(words, " "), 1, LONGEST))


def instructs(text: Column) -> Column:
    """Whether a text holds a phrase that would steer a model; null stays null."""
    found = F.lit(False)
    for pattern in INJECTIONS:
        found = found | text.rlike(f"(?im){pattern}")
    return found


def stem(word: Column) -> Column:
    """The light stem of a normalised word of Arabic or plain English letters; other words stay as they are."""
    arabic = F.regexp_replace(F.regexp_replace(word, rf"^(?:{AR_PREFIXES})(?=.{{{AR_STEM},}}$)", ""), rf"^(.{{{AR_STEM},}}?)(?:{AR_SUFFIXES})$", "$1")
    singular = (
        F.when(word.rlike("^..+ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:sses|ches|shes|xes|zes)$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$") & ~word.rlike("(?:ss|us|is)$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )

    def verb(w):
        root = F.regexp_extract(w, "^(..+?)(?:ing|ed)$", 1)
        return F.when(root.rlike("[aeiou]"), F.regexp_replace(root, r"^(.{2,}([bcdfghjkmnpqrtvwxy]))\2$", "$1")).otherwise(w)

    def ended(w):
        return F.regexp_replace(F.when((F.length(w) > 3) & w.endswith("y"), F.regexp_replace(w, "y$", "i")).otherwise(w), "^(..+)e$", "$1")

    english = F.when(F.length(word) > 3, bound(bound(singular, verb), ended)).otherwise(F.regexp_replace(word, "^(..)e$", "$1"))
    return F.when(word.rlike("^[ء-ي]+$"), arabic).when(word.rlike("^[A-Za-z]+$"), english).otherwise(word)
