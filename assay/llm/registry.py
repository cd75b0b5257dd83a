"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .decontaminate import op11_benchmark_decontamination
from .embed_dedup import op8_embedding_dedup
from .fingerprints import op1_fingerprints
from .langid import op4_language_id
from .line_dedup import op10_line_dedup
from .merkle import op12_merkle_manifest
from .ngram_join import op9_ngram_jaccard
from .packing import op5_packing
from .periodic_runs import op13_periodic_runs
from .secret_scan import op6_secret_scan
from .toxicity import op7_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_url_filter, op3_bpe, op4_language_id, op5_packing, op6_secret_scan, op7_toxicity, op8_embedding_dedup, op9_ngram_jaccard, op10_line_dedup, op11_benchmark_decontamination, op12_merkle_manifest, op13_periodic_runs)}
ORACLE_SQL = {"op2_url_filter": OP2_SQL}
