"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from panelspark.llm.bpe_codec import op6_bpe_codec
from panelspark.llm.conversation_repair import op11_conversation_repair, op11_sql
from panelspark.llm.jaccard_join import op7_ngram_jaccard_join
from panelspark.llm.language_id import op1_language_id
from panelspark.llm.license_scan import op4_license_scan
from panelspark.llm.mixing import op12_source_mixing
from panelspark.llm.packing import op9_packing
from panelspark.llm.quality_classifier import op8_quality_classifier
from panelspark.llm.quality_rules import op5_quality_rules
from panelspark.llm.token_counts import op10_token_counts
from panelspark.llm.url_filter import op3_url_filter, op3_sql
from panelspark.llm.vector_search import op2_nearest_neighbours
from panelspark.llm.whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_language_id, op2_nearest_neighbours, op3_url_filter, op4_license_scan, op5_quality_rules, op6_bpe_codec, op7_ngram_jaccard_join, op8_quality_classifier, op9_packing, op10_token_counts, op11_conversation_repair, op12_source_mixing, op13_embedding_whitening)}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": op3_sql(), "op11_conversation_repair": op11_sql()}
