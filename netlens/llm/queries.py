"""The queries of this package, and SQL for those that SQL can express."""

from netlens.llm import chat, divergence, licenses
from netlens.llm.chat import op6_chat_formatting
from netlens.llm.divergence import op12_source_divergence
from netlens.llm.language import op10_language_id
from netlens.llm.licenses import op4_license_scan
from netlens.llm.media import op8_media_columns
from netlens.llm.mixing import op5_mixing
from netlens.llm.packing import op1_packing
from netlens.llm.quality import op2_quality_rules
from netlens.llm.scoring import op7_lm_scoring
from netlens.llm.secrets import op9_secret_scan
from netlens.llm.sentencepieces import op11_sentencepiece
from netlens.llm.simhash import op3_simhash_dedup
from netlens.llm.spelling import op13_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_quality_rules,
        op3_simhash_dedup,
        op4_license_scan,
        op5_mixing,
        op6_chat_formatting,
        op7_lm_scoring,
        op8_media_columns,
        op9_secret_scan,
        op10_language_id,
        op11_sentencepiece,
        op12_source_divergence,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.oracle(),
    "op6_chat_formatting": chat.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
