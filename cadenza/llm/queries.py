"""The operators' queries, and SQL where SQL can express one."""

from cadenza.llm.attention_lm import op5_attention_lm
from cadenza.llm.centroids import OP11_SQL, op11_centroid_clustering
from cadenza.llm.decontaminate import op8_decontamination
from cadenza.llm.fertility import op1_fertility_rules
from cadenza.llm.jaccard_join import op2_jaccard_join
from cadenza.llm.merkle import OP12_SQL, op12_merkle_manifest
from cadenza.llm.oracles import OP2_SQL, OP6_SQL
from cadenza.llm.packing import op3_packing
from cadenza.llm.pii import op9_pii
from cadenza.llm.quality_qda import op10_quality_classifier
from cadenza.llm.substring_index import op6_substring_dedup
from cadenza.llm.suffix_array import op13_suffix_dedup
from cadenza.llm.token_counts import op7_token_counts
from cadenza.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_fertility_rules,
        op2_jaccard_join,
        op3_packing,
        op4_warc,
        op5_attention_lm,
        op6_substring_dedup,
        op7_token_counts,
        op8_decontamination,
        op9_pii,
        op10_quality_classifier,
        op11_centroid_clustering,
        op12_merkle_manifest,
        op13_suffix_dedup,
    )
}
ORACLE_SQL = {"op2_jaccard_join": OP2_SQL, "op4_warc": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op11_centroid_clustering": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
