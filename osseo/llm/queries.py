"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from osseo.llm.align import op13_alignment
from osseo.llm.bpe import op5_bpe
from osseo.llm.codes import OP11_SQL, op11_vector_codes
from osseo.llm.decontaminate import op6_decontamination
from osseo.llm.language import op1_language_id
from osseo.llm.ledger import OP12_SQL, op12_quality_rules
from osseo.llm.licenses import op10_license_scan
from osseo.llm.pii import op7_pii
from osseo.llm.quality import op8_quality
from osseo.llm.repeats import op9_substring_dedup
from osseo.llm.simhash import op3_simhash
from osseo.llm.toxicity import op2_toxicity
from osseo.llm.topk import OP4_SQL, op4_topk

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op4_topk": OP4_SQL, "op11_vector_codes": OP11_SQL, "op12_quality_rules": OP12_SQL}
