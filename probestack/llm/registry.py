"""Queries of this folder, and their SQL where SQL can express them."""

from probestack.llm.decontaminate import OP2_SQL, op2_decontaminate
from probestack.llm.embed_dedup import OP4_SQL, op4_embed_dedup
from probestack.llm.extract import op3_extract
from probestack.llm.langid import op1_language_id
from probestack.llm.licenses import op5_licenses
from probestack.llm.lm_score import op6_lm_score
from probestack.llm.mixing import OP9_SQL, op9_mixing
from probestack.llm.near_dedup import OP8_SQL, op8_near_dedup
from probestack.llm.token_counts import op7_token_counts
from probestack.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_extract": op3_extract,
    "op4_embed_dedup": op4_embed_dedup,
    "op5_licenses": op5_licenses,
    "op6_lm_score": op6_lm_score,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op4_embed_dedup": OP4_SQL,
    "op8_near_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_warc": OP10_SQL,
}
