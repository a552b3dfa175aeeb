"""The registered queries and their SQL; one entry per operator."""

from __future__ import annotations

from loglattice.llm import fingerprint, minhash, packing, pieces, repetition, secrets, suffix, toxicity, urlrules, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1,
    "op2_multiset_fingerprints": fingerprint.op2,
    "op3_secret_scan": secrets.op3,
    "op4_warc_shards": warc.op4,
    "op5_repetition_rules": repetition.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_url_rules": urlrules.op7,
    "op8_toxicity": toxicity.op8,
    "op9_sentencepiece": pieces.op9,
    "op10_suffix_dedup": suffix.op10,
}
SQL = {
    "op2_multiset_fingerprints": fingerprint.OP2_SQL,
    "op3_secret_scan": secrets.OP3_SQL,
    "op4_warc_shards": warc.OP4_SQL,
    "op5_repetition_rules": repetition.OP5_SQL,
    "op7_url_rules": urlrules.OP7_SQL,
}
