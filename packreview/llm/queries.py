"""The registered queries of this subpackage. Secrets, vectors, near-duplicates, decontamination, divergence and spelling have
SQL; the others have none, as DuckDB has no tokenizers and no such models: tests hold them against brute force."""

from packreview.llm.bpe import op6_byte_bpe
from packreview.llm.decontam import op10_decontamination
from packreview.llm.divergence import op12_divergence
from packreview.llm.langid import op1_language
from packreview.llm.minhash import op9_minhash
from packreview.llm.oracle import ORACLE
from packreview.llm.pii import op11_personal_data
from packreview.llm.quality import op2_quality
from packreview.llm.secrets import op3_secrets
from packreview.llm.shards import op7_sharding
from packreview.llm.spelling import op13_spelling
from packreview.llm.tokenids import op5_token_ids
from packreview.llm.toxicity import op8_toxicity
from packreview.llm.vectors import op4_vectors

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_quality, op3_secrets, op4_vectors, op5_token_ids, op6_byte_bpe, op7_sharding, op8_toxicity,
        op9_minhash, op10_decontamination, op11_personal_data, op12_divergence, op13_spelling,
    )
}
