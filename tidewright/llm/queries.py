"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .audit import OP12_SQL, op12_filter_audit
from .flat import op4_token_counts
from .mixing import OP2_SQL, op2_mixing
from .neardup import op10_embedding_neardup
from .packing import op8_packing
from .shingles import op9_ngram_jaccard
from .quality import op5_quality
from .sharding import op7_sharding
from .spelling import op13_spelling_variants
from .tokens import op1_token_ids
from .topk import OP6_SQL, op6_top_k
from .toxicity import op3_toxicity
from .warc import OP11_SQL, op11_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_ids, op2_mixing, op3_toxicity, op4_token_counts, op5_quality, op6_top_k, op7_sharding, op8_packing, op9_ngram_jaccard, op10_embedding_neardup, op11_warc, op12_filter_audit, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op6_top_k": OP6_SQL, "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL}
