"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, jaccard, langid, license_scan, minhash, mixing, packing, ppm, urlfilter, warc
from .common import table


def tokenizer_path() -> str:
    """The public vocabulary that packing counts by."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_score(spark, sf_dir):
    return ppm.score_held_out(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard.search(table(spark, sf_dir, "documents"))


def op9_fingerprint(spark, sf_dir):
    return minhash.compare_with_next(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_license_scan, op2_source_mix, op3_warc, op4_language_id, op5_packing, op6_lm_score, op7_url_filter, op8_jaccard_join, op9_fingerprint, op10_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op1_license_scan": license_scan.oracle(),
        "op10_exact_dedup": f"""WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    }
