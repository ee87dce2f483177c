"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from factloom.llm import alignment, chat, divergence, exact, grammar, imatch, langid, mixing, pieces, pii, secrets, sharding, simhash
from factloom.llm.common import conversations, documents


def op1_secret_scans(spark, sf_dir):
    return secrets.secret_digest(documents(spark, sf_dir))


def op2_sentencepiece_dropout(spark, sf_dir):
    return pieces.encoded_digest(documents(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_mixing(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir))


def op7_pii_surrogates(spark, sf_dir):
    return pii.pseudonymised_documents(documents(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_document_fingerprints(spark, sf_dir):
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op10_chat_rotation(spark, sf_dir):
    return chat.rotated(conversations(spark, sf_dir))


def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.aligned_documents(documents(spark, sf_dir))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(documents(spark, sf_dir))


def op13_token_ids(spark, sf_dir):
    return grammar.written_documents(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_sentencepiece_dropout,
        op3_language_id,
        op4_exact_dedup,
        op5_simhash_near_dedup,
        op6_mixing,
        op7_pii_surrogates,
        op8_sharding,
        op9_document_fingerprints,
        op10_chat_rotation,
        op11_tokenizer_alignment,
        op12_source_divergence,
        op13_token_ids,
    )
}

_NORM = r"""regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"""

ORACLES: dict[str, str] = {
    "op1_secret_scans": secrets.oracle(),
    "op6_mixing": mixing.oracle(),
    "op8_sharding": sharding.oracle(),
    "op12_source_divergence": divergence.oracle(),
    "op9_document_fingerprints": imatch.oracle(),
    "op10_chat_rotation": chat.oracle(),
    "op4_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, nth = 1 AS kept, sha256(norm) AS text_sha256
        FROM r""",
}
