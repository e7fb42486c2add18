"""Declared schemas; nothing in the library infers one from data."""

from pyspark.sql import types as T

# The keys of an application document, in the order of the format.
DOCUMENT_KEYS = (
    "decision", "title", "abstract", "claims", "full_description", "background", "summary",
    "main_cpc_label", "filing_date", "patent_issue_date", "date_published", "examiner_id",
    "main_ipcr_label",
)

# The example columns, and the document keys that are renamed on the way.
EXAMPLE_COLUMNS = (
    "patent_number", "decision", "title", "abstract", "claims", "background", "summary",
    "description", "cpc_label", "ipc_label", "filing_date", "patent_issue_date",
    "date_published", "examiner_id",
)
EXAMPLE_SOURCE = {
    "patent_number": "application_number",
    "description": "full_description",
    "cpc_label": "main_cpc_label",
    "ipc_label": "main_ipcr_label",
}

# The metadata columns that are read.
METADATA = T.StructType(
    [
        T.StructField("application_number", T.StringType()),
        T.StructField("filing_date", T.TimestampNTZType()),
        *(
            T.StructField(name, T.StringType())
            for name in (
                "decision", "main_cpc_label", "main_ipcr_label", "examiner_id",
                "examiner_full_name", "uspc_class", "uspc_subclass", "decision_as_of_2020",
            )
        ),
    ]
)

DOCUMENT = T.StructType([T.StructField(key, T.StringType()) for key in DOCUMENT_KEYS])
EXAMPLE = T.StructType([T.StructField(name, T.StringType()) for name in EXAMPLE_COLUMNS])
