"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import bpe, chat, codes, embeddings, exact, leaks, packing, phrases, quality, sketch, suffix, tokenfiles, toxicity


def queries():
    return {
        "op1_quality_classifier": quality.query,
        "op2_suffix_dedup": suffix.query,
        "op3_toxicity": toxicity.query,
        "op4_packing": packing.query,
        "op5_exact_dedup": exact.query,
        "op6_chat_formatting": chat.query,
        "op7_minhash_neardup": sketch.query,
        "op8_byte_bpe": bpe.query,
        "op9_token_files": tokenfiles.query,
        "op10_embedding_neardup": embeddings.query,
        "op11_vector_codes": codes.query,
        "op12_collocations": phrases.query,
        "op13_decontamination": leaks.query,
    }


def oracle_sql():
    return {"op5_exact_dedup": exact.SQL, "op6_chat_formatting": chat.SQL, "op11_vector_codes": codes.SQL, "op12_collocations": phrases.SQL, "op13_decontamination": leaks.SQL}
