"""Registered queries of the package and the SQL that defines those SQL can express."""

from __future__ import annotations

from barquarry.llm import merkle, metric_search, ranked_search, secret_scan, shingle_join, url_filter
from barquarry.llm.attention_lm import op10_lm_scoring
from barquarry.llm.languages import op9_language_id
from barquarry.llm.merkle import op12_merkle_manifest
from barquarry.llm.metric_search import op5_exact_top_k
from barquarry.llm.packing import op2_best_fit_packing
from barquarry.llm.pieces import op6_sentencepiece
from barquarry.llm.quality import op3_quality_rules
from barquarry.llm.ranked_search import op11_ranked_search
from barquarry.llm.secret_scan import op8_secret_scan
from barquarry.llm.shingle_join import op4_ngram_jaccard_join
from barquarry.llm.token_counts import op7_token_counts
from barquarry.llm.toxicity import op1_toxicity
from barquarry.llm.url_filter import op13_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": shingle_join.ORACLE,
    "op5_exact_top_k": metric_search.ORACLE,
    "op8_secret_scan": secret_scan.oracle(),
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_merkle_manifest": merkle.oracle(),
    "op13_url_filter": url_filter.ORACLE,
}
