from labelmill.functions.keys import hash_below, seeded_key, unit_interval
from labelmill.functions.labels import DECISION_LABELS, decision_label, examiner_text
from labelmill.functions.text import normalise, tokens, words_of

__all__ = [
    "DECISION_LABELS",
    "decision_label",
    "examiner_text",
    "hash_below",
    "normalise",
    "seeded_key",
    "tokens",
    "unit_interval",
    "words_of",
]
