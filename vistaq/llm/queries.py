"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, line_dedup, media, middle, mixing, near_dedup, packing, private, quality, resampling, secrets, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_warc": warc.op8_warc,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_private_data": private.op11_private_data,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_fill_in_middle": middle.op13_fill_in_middle,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_fill_in_middle": middle.OP13_SQL,
}
