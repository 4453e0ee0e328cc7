"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from bruit.llm.centroids import OP13_SQL, op13_centroid_clustering
from bruit.llm.conversation_repair import op11_conversation_repair
from bruit.llm.html_text import op7_html_extract
from bruit.llm.huffman import op5_huffman_tokens
from bruit.llm.language_id import op12_language_id
from bruit.llm.line_dedup import OP3_SQL, op3_line_dedup
from bruit.llm.media import op9_media_png
from bruit.llm.mixing import OP6_SQL, op6_source_mix
from bruit.llm.ngram_join import OP8_SQL, op8_ngram_jaccard
from bruit.llm.quality_classifier import op4_quality_classifier
from bruit.llm.quality_rules import op10_quality_rules
from bruit.llm.sentencepiece_codec import op2_sentencepiece
from bruit.llm.sharding import op1_histogram_shards

QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_huffman_tokens": op5_huffman_tokens,
    "op6_source_mix": op6_source_mix,
    "op7_html_extract": op7_html_extract,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_media_png": op9_media_png,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_language_id": op12_language_id,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
