"""Decision labels and the examiner text feature."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision to label.
DECISION_LABELS = {
    "REJECTED": 0,
    "ACCEPTED": 1,
    "PENDING": 2,
    "CONT-REJECTED": 3,
    "CONT-ACCEPTED": 4,
    "CONT-PENDING": 5,
}


def decision_label(decision: Column, strict: bool = True) -> Column:
    """Label of a decision. An unknown or null decision fails the query when ``strict``, else is null.

    A map lookup would return null for a missing key even under ANSI mode, hence the CASE.
    """
    chain = None
    for name, label in DECISION_LABELS.items():
        hit = decision == F.lit(name)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    if strict:
        problem = F.concat(F.lit("unknown decision: "), F.coalesce(decision, F.lit("null")))
        return chain.otherwise(F.raise_error(problem).cast("int"))
    return chain.otherwise(F.lit(None).cast("int"))


def examiner_text(examiner_id: Column, text: Column) -> Column:
    """``Examiner id: <id without its last two characters> <text>``; ids look like ``12345.0``."""
    kept = F.substring(examiner_id, F.lit(1), F.greatest(F.length(examiner_id) - 2, F.lit(0)))
    return F.concat(F.lit("Examiner id: "), kept, F.lit(" "), text)
