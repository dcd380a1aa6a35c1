"""The registered queries of the training-data operators, and the SQL that some of them are compared with."""

from __future__ import annotations

from . import bpe, licences, line_crf, minmax, mixing, near_vectors, secret_scan, sharding, topk, url_filter

QUERIES = {
    "op1_near_vectors": near_vectors.op1_near_vectors,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_minmax_near_dedup": minmax.op4_minmax_near_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_bpe": bpe.op6_bpe,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_crf": line_crf.op10_line_crf,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_vectors": near_vectors.SQL,
    "op2_licence_scan": licences.SQL,
    "op3_exact_topk": topk.SQL,
    "op4_minmax_near_dedup": minmax.SQL,
    "op9_url_filter": url_filter.SQL,
}
