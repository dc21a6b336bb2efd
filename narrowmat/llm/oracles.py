"""SQL for DuckDB with the results of those queries that SQL can express."""

from narrowmat.llm import decontamination, filter_audit

ORACLES = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
}
