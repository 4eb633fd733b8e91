"""The queries of this subpackage."""

from __future__ import annotations

from loomery.llm.embedding_dedup import op3_embedding_dedup
from loomery.llm.fill_middle import OP12_SQL, op12_fill_middle
from loomery.llm.html_text import OP13_SQL, op13_html_text
from loomery.llm.language_id import op5_language_id
from loomery.llm.lm_scoring import op1_lm_scoring
from loomery.llm.mixing import op4_mixing
from loomery.llm.packing import op7_packing
from loomery.llm.pii import op6_pii
from loomery.llm.quality_classifier import op10_quality_classifier
from loomery.llm.quality_rules import op8_quality_rules
from loomery.llm.simhash import op2_simhash_dedup
from loomery.llm.spelling import OP11_SQL, op11_spelling
from loomery.llm.url_filters import OP9_SQL, op9_url_filters

FUNCTIONS = (
    op1_lm_scoring, op2_simhash_dedup, op3_embedding_dedup, op4_mixing, op5_language_id, op6_pii, op7_packing, op8_quality_rules, op9_url_filters,
    op10_quality_classifier, op11_spelling, op12_fill_middle, op13_html_text,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLE: dict[str, str] = {"op9_url_filters": OP9_SQL, "op11_spelling": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_html_text": OP13_SQL}
