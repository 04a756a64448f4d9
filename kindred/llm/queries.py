"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from kindred.llm import language, media, mixing, neardup, packing, pii, secrets, sharding, tokenfile, vectors

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_secrets": secrets.op2_secrets,
    "op3_media": media.op3_media,
    "op4_pii": pii.op4_pii,
    "op5_tokenfile": tokenfile.op5_tokenfile,
    "op6_vectors": vectors.op6_vectors,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_language": language.op10_language,
}

ORACLE_SQL = {
    "op6_vectors": vectors.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_sharding": sharding.OP8_SQL,
}
