"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from rowsmith.llm.decontaminate import OP8_SQL, op8_decontaminate
from rowsmith.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from rowsmith.llm.language_id import op1_language_id
from rowsmith.llm.lexical_search import OP11_SQL, op11_lexical_search
from rowsmith.llm.mixing import OP5_SQL, op5_mixing
from rowsmith.llm.ngram_jaccard import OP7_SQL, op7_ngram_jaccard
from rowsmith.llm.quality_classifier import op9_quality_classifier
from rowsmith.llm.quality_rules import op10_quality_rules
from rowsmith.llm.reply_trees import OP6_SQL, op6_reply_trees
from rowsmith.llm.secret_scan import OP12_SQL, op12_secret_scan
from rowsmith.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from rowsmith.llm.url_rules import OP3_SQL, op3_url_rules
from rowsmith.llm.vector_packing import op2_vector_packing

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_vector_packing": op2_vector_packing,
    "op3_url_rules": op3_url_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_reply_trees": op6_reply_trees,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op6_reply_trees": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
