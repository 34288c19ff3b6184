"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, html_extract, near_dedup, packing, ppm, quality, secrets, suffixes, warc


def queries() -> dict:
    return {
        "op1_order_minhash": near_dedup.op1_order_minhash,
        "op2_bpe": bpe.op2_bpe,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_sparse_suffix_arrays": suffixes.op4_sparse_suffix_arrays,
        "op5_warc": warc.op5_warc,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_ppm": ppm.op7_ppm,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_html_extraction": html_extract.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op5_warc": warc.OP5_SQL, "op9_secret_scan": secrets.OP9_SQL}
