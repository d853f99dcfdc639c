"""The queries of this package, one opN_<name> an operator, and the SQL twins of those that SQL can express."""

from lodestone.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from lodestone.llm.exact_topk import OP4_SQL, op4_exact_topk
from lodestone.llm.html_extract import op6_html_extraction
from lodestone.llm.language_id import op2_language_id
from lodestone.llm.mixing import op9_mixing_targets
from lodestone.llm.near_dedup import op1_simhash_near_dedup
from lodestone.llm.packing import op8_best_fit_packing
from lodestone.llm.quality_rules import OP5_SQL, op5_quality_rules
from lodestone.llm.spelling import op12_spelling_variants
from lodestone.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from lodestone.llm.token_files import op10_token_files
from lodestone.llm.vector_codes import OP11_SQL, op11_vector_codes
from lodestone.llm.warc import OP3_SQL, op3_warc_segments

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_language_id,
        op3_warc_segments,
        op4_exact_topk,
        op5_quality_rules,
        op6_html_extraction,
        op7_substring_dedup,
        op8_best_fit_packing,
        op9_mixing_targets,
        op10_token_files,
        op11_vector_codes,
        op12_spelling_variants,
        op13_exact_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op3_warc_segments": OP3_SQL,
    "op4_exact_topk": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_exact_dedup": OP13_SQL,
}
