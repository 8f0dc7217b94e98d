"""Query understanding from a table of rules: intent, its retrieval hints and expansion terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns by intent, in the order in which intents are tried. They are matched against lower-case text; those with a capital I hence never match unless ``ignore_case`` is set.
PATTERNS = {
    "policy": [
        r"what\s+is\s+the\s+policy",
        r"policy\s+(for|on|about|regarding|related\s+to)",
        r"are\s+(we|employees?|staff)\s+allowed\s+to",
        r"is\s+it\s+(allowed|permitted|acceptable|mandatory|required)",
        r"company\s+rule[s]?",
        r"what\s+are\s+the\s+rule[s]?",
        r"code\s+of\s+conduct",
        r"compliance\s+(rule|requirement|policy)",
        r"regulation[s]?\s+(on|for|about)",
        r"guideline[s]?\s+(on|for|about)",
    ],
    "procedure": [
        r"how\s+(do|to|should|can|must)\s+I",
        r"how\s+to\s+\w+",
        r"what\s+are\s+the\s+steps\s+(to|for|in)",
        r"step[s]?\s+(to|for|in|of)",
        r"process\s+(for|of|to)",
        r"procedure\s+(for|to|of)",
        r"how\s+does\s+.+\s+work",
        r"walkthrough\s+(for|of)",
        r"instructions?\s+(for|to|on)",
        r"guide\s+(for|to|on)",
    ],
    "contact": [
        r"who\s+(should|do|can|to)\s+(I\s+)?(contact|call|email|reach|ask|report\s+to)",
        r"who\s+is\s+(responsible|in\s+charge|the\s+owner|the\s+poc)",
        r"point\s+of\s+contact",
        r"who\s+(handles|manages|owns|approves)",
        r"(email|phone|contact)\s+(of|for|address\s+of)",
        r"which\s+(team|department|person)\s+(handles|is\s+responsible)",
    ],
    "deadline": [
        r"when\s+(is|are|was)\s+(the\s+)?(deadline|due\s+date|submission\s+date|cutoff)",
        r"deadline\s+(for|of|to)",
        r"due\s+(date|by)\s+(for|of)?",
        r"by\s+when\s+(should|must|do|is)",
        r"timeline\s+(for|of)",
        r"how\s+long\s+(does|will|should)\s+it\s+take",
        r"turnaround\s+time",
        r"processing\s+time",
        r"when\s+will\s+I\s+(receive|get|hear)",
    ],
    "requirement": [
        r"what\s+(do|should|must)\s+I\s+(need|prepare|provide|submit|bring)",
        r"requirement[s]?\s+(for|to|of)",
        r"prerequisite[s]?\s+(for|to)",
        r"document[s]?\s+(needed|required|to\s+submit|to\s+provide)",
        r"eligib(le|ility)\s+(for|to)",
        r"qualif(y|ication[s]?)\s+(for|to)",
        r"criteria\s+(for|to|of)",
        r"condition[s]?\s+(for|to\s+be)",
    ],
    "definition": [
        r"what\s+(is|are)\s+(a\s+|an\s+|the\s+)?\w+",
        r"define\s+\w+",
        r"definition\s+of",
        r"meaning\s+of",
        r"explain\s+what\s+.+\s+(is|means)",
        r"what\s+does\s+.+\s+mean",
        r"what\s+does\s+.+\s+stand\s+for",
    ],
    "summary": [
        r"(summary|overview|introduction)\s+(of|to|about)",
        r"what\s+is\s+this\s+document\s+about",
        r"(briefly|shortly)\s+(describe|explain|summarize|outline)",
        r"give\s+(me\s+)?(a\s+)?(brief|quick|short|high.level)\s+",
        r"main\s+(point[s]?|topic[s]?|content[s]?|section[s]?)",
        r"summarize\s+(this|the)\s+(document|file|report|policy)",
        r"table\s+of\s+contents",
    ],
}
#: Confidence, pages to prefer, factor for these pages, terms that expand a question.
HINTS = {
    "policy": (0.92, [1, 2, 3], 4.0, "policy rule guideline regulation compliance allowed prohibited"),
    "procedure": (0.90, None, None, "steps process procedure how to instructions workflow"),
    "contact": (0.92, [1], 6.0, "contact responsible owner email team department point of contact"),
    "deadline": (0.88, None, None, "deadline due date timeline schedule by when submission date"),
    "requirement": (0.88, None, None, "requirement needed must provide eligibility criteria submit"),
    "definition": (0.85, [1, 2], 3.0, "definition meaning refers to is defined as stands for"),
    "summary": (0.90, [1, 2], 5.0, "summary overview purpose scope introduction about"),
    "general": (1.0, None, None, None),
}
WHITE = r"^\s+|\s+$"


def classify(question: Column, ignore_case: bool = False) -> Column:
    """The first intent with a pattern that matches, else ``general``."""
    text = F.regexp_replace(F.lower(question), WHITE, "")
    out = None
    for intent, patterns in PATTERNS.items():
        rule = ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)
        out = F.when(text.rlike(rule), intent) if out is None else out.when(text.rlike(rule), intent)
    return F.coalesce(out.otherwise("general"), F.lit("general"))


def rules(spark: SparkSession) -> DataFrame:
    """One row for each intent: (intent, confidence, page_filter, boost, terms)."""
    return spark.createDataFrame([(i, *h) for i, h in HINTS.items()], "intent string, confidence double, page_filter array<int>, boost double, terms string")


def understood(questions: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Adds intent, confidence, page_filter, boost and expanded to questions. The rule table has eight rows and is broadcast."""
    named = questions.withColumn("intent", classify(F.col("question"), ignore_case))
    joined = named.join(F.broadcast(rules(questions.sparkSession)), "intent")
    return joined.withColumn("expanded", F.concat_ws(" ", "question", "terms")).drop("terms")
