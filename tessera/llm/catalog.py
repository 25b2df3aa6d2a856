"""Queries and DuckDB SQL of this folder."""

from __future__ import annotations

from tessera.llm.centroid_clusters import OP12_SQL, op12_hilbert_clusters
from tessera.llm.chat_format import OP2_SQL, op2_chat_fingerprint
from tessera.llm.decontaminate import op6_qgram_decontamination
from tessera.llm.embedding_forest import OP7_SQL, op7_embedding_forest
from tessera.llm.license_scan import OP13_SQL, op13_license_templates
from tessera.llm.line_dedup import OP8_SQL, op8_line_dedup
from tessera.llm.minhash_forest import OP5_SQL, op5_minhash_forest
from tessera.llm.packing import op4_packing
from tessera.llm.periodic_runs import op11_periodic_runs
from tessera.llm.pii import op10_pii_weak_supervision
from tessera.llm.quality import op3_quality_bayes
from tessera.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from tessera.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_fingerprint": op2_chat_fingerprint,
    "op3_quality_bayes": op3_quality_bayes,
    "op4_packing": op4_packing,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_qgram_decontamination": op6_qgram_decontamination,
    "op7_embedding_forest": op7_embedding_forest,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii_weak_supervision": op10_pii_weak_supervision,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hilbert_clusters": op12_hilbert_clusters,
    "op13_license_templates": op13_license_templates,
}

ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_chat_fingerprint": OP2_SQL,
    "op5_minhash_forest": OP5_SQL,
    "op7_embedding_forest": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op12_hilbert_clusters": OP12_SQL,
    "op13_license_templates": OP13_SQL,
}
