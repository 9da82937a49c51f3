"""One query for each operator of this folder, and the SQL that gives the same rows where SQL can."""

from panelcast.llm import hard_negatives, url_filter
from panelcast.llm.ann import op2_posting_lists
from panelcast.llm.line_quality import op3_line_quality
from panelcast.llm.lm_score import op9_bloom_lm
from panelcast.llm.mixture import op7_source_mixture
from panelcast.llm.near_dup import op5_near_duplicates
from panelcast.llm.packing import op4_retrieval_packing
from panelcast.llm.pattern_packing import op13_pattern_packing
from panelcast.llm.sanitise import op10_disclosure
from panelcast.llm.token_attribution import op8_token_attribution
from panelcast.llm.tokenizer_alignment import op11_tokenizer_alignment
from panelcast.llm.toxicity import op1_toxicity

QUERIES = {q.__name__: q for q in (
    op1_toxicity, op2_posting_lists, op3_line_quality, op4_retrieval_packing, op5_near_duplicates, url_filter.op6_url_filter,
    op7_source_mixture, op8_token_attribution, op9_bloom_lm, op10_disclosure,
    op11_tokenizer_alignment, hard_negatives.op12_hard_negatives, op13_pattern_packing)}

ORACLE = {"op6_url_filter": url_filter.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
