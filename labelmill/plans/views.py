"""The bindings once more, as SQL views for the oracle queries."""

from __future__ import annotations

_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
TOKEN_PATTERN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def words(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{TOKEN_PATTERN}')"


def key(identifier: str, seed: int = 1729) -> str:
    return f"md5(concat('{seed}-', {identifier}))"


def hash_split(identifier: str, seed: int = 1729) -> str:
    digits = f"('0x' || substr({key(identifier, seed)}, 1, 8))::BIGINT"
    return f"CASE WHEN {digits} % 10000 < 8500 THEN 'train' ELSE 'validation' END"


LABEL = """CASE decision WHEN 'REJECTED' THEN 0 WHEN 'ACCEPTED' THEN 1 WHEN 'PENDING' THEN 2
 WHEN 'CONT-REJECTED' THEN 3 WHEN 'CONT-ACCEPTED' THEN 4 WHEN 'CONT-PENDING' THEN 5 END"""

# name: (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "filings": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS application_number, o_orderdate AS filing_date,
 CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'REJECTED' ELSE
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PENDING' WHEN '2' THEN 'CONT-REJECTED'
   WHEN '3' THEN 'CONT-ACCEPTED' WHEN '4' THEN 'CONT-PENDING' ELSE 'error' END END AS decision,
 concat(o_custkey, '.0') AS examiner_id, o_custkey, o_totalprice FROM orders""",
    ),
    "classified": (
        ("filings",),
        """SELECT application_number, filing_date, decision, c_mktsegment AS main_cpc_label,
 n_name AS main_ipcr_label, examiner_id, c_name AS examiner_full_name, c_mktsegment AS uspc_class,
 n_name AS uspc_subclass, decision AS decision_as_of_2020, o_totalprice
 FROM filings JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "decided": (
        ("filings",),
        f"SELECT *, {LABEL} AS labels FROM filings WHERE decision IN ('ACCEPTED', 'REJECTED')",
    ),
    "predictions": (
        ("decided",),
        """SELECT application_number, labels AS label, o_totalprice / 500000.0::DOUBLE AS score,
 CASE WHEN o_totalprice / 500000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred,
 (labels = CASE WHEN o_totalprice / 500000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END) AS correct FROM decided""",
    ),
    "outcomes": (
        ("classified", "predictions"),
        """SELECT c.*, CASE WHEN p.correct THEN 'Correct' ELSE 'Incorrect' END AS Prediction
 FROM classified c JOIN predictions p USING (application_number)""",
    ),
    "texts": (
        (),
        "SELECT CAST(doc_id AS VARCHAR) AS application_number, text, lang, source FROM documents",
    ),
    "labelled": (
        (),
        f"""SELECT CAST(d.doc_id AS VARCHAR) AS application_number, quality AS labels, text,
 {hash_split('d.doc_id')} AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "docs": (
        (),
        """SELECT CAST(year(coalesce(o_orderdate, TIMESTAMP '1900-01-01')) AS INTEGER) AS filing_year, CAST(d.doc_id AS VARCHAR) AS application_number,
 CASE quality WHEN 1 THEN 'ACCEPTED' WHEN 0 THEN 'REJECTED' ELSE 'PENDING' END AS decision,
 concat(source, '-', d.doc_id) AS title,
 concat(lang, ' document of ', n_chars, ' characters') AS abstract, text AS claims,
 text AS full_description, source AS background, lang AS summary, source AS main_cpc_label,
 strftime(coalesce(o_orderdate, TIMESTAMP '1900-01-01'), '%Y-%m-%d') AS filing_date, '' AS patent_issue_date,
 strftime(coalesce(o_orderdate, TIMESTAMP '1900-01-01'), '%Y%m%d') AS date_published, concat(coalesce(o_custkey, 0), '.0') AS examiner_id,
 lang AS main_ipcr_label
 FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "tokens": (
        ("texts",),
        f"""SELECT application_number, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos
 FROM (SELECT application_number, {words('text')} AS w FROM texts)""",
    ),
    "vocab": (
        ("tokens",),
        """SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id, n
 FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token HAVING count(*) >= 3)
 QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 9998""",
    ),
    "encoded": (
        ("texts", "tokens", "vocab"),
        """SELECT application_number, coalesce(list(coalesce(token_id, 1) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids
 FROM texts LEFT JOIN (SELECT * FROM tokens WHERE pos <= 512) USING (application_number)
 LEFT JOIN vocab USING (token) GROUP BY application_number""",
    ),
    "log": (
        (),
        """SELECT user_id AS run_id, event_id AS entry, strftime(ts, '%Y-%m-%d') AS epoch, event_type AS tag,
 value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events""",
    ),
    "joined": (
        ("filings", "docs"),
        """SELECT f.application_number, f.filing_date, year(f.filing_date) AS filing_year, f.decision,
 d.application_number IS NOT NULL AS found, d.decision AS doc_decision, d.title, d.abstract, d.claims,
 d.full_description, d.background, d.summary, d.main_cpc_label, d.main_ipcr_label,
 d.filing_date AS doc_filing_date, d.patent_issue_date, d.date_published, d.examiner_id
 FROM filings f LEFT JOIN docs d ON d.application_number = f.application_number
 AND d.filing_year = year(f.filing_date)""",
    ),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def sql(body: str, *views: str, extra: str = "") -> str:
    """``body`` with the named views, and what they need, in front."""
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in _needed(views, [])]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}" if parts else body
