"""Driver queries of this subpackage, and their oracle SQL."""

from __future__ import annotations

from loomgraph.llm.ann import op10_ann
from loomgraph.llm.decontaminate import OP5_SQL, op5_decontamination
from loomgraph.llm.line_dedup import OP6_SQL, op6_line_dedup
from loomgraph.llm.mixing import OP8_SQL, op8_source_mix
from loomgraph.llm.near_dedup import OP4_SQL, op4_minhash_near_dedup
from loomgraph.llm.paragraph_dedup import op9_paragraph_dedup
from loomgraph.llm.quality import op1_quality_classifier
from loomgraph.llm.secrets import OP3_SQL, op3_secret_scan
from loomgraph.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from loomgraph.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_ann": op10_ann,
}

ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_source_mix": OP8_SQL,
}
