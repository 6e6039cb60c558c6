"""Queries of this subpackage and their SQL, for the entry module."""

from . import decontamination, filter_audit, language_id, licenses, line_dedup, lm_scoring, media, merkle, mixing, quality, repeats, sharding, simhash

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_language_id": language_id.op2_language_id,
    "op3_sharding": sharding.op3_sharding,
    "op4_simhash": simhash.op4_simhash,
    "op5_media": media.op5_media,
    "op6_licenses": licenses.op6_licenses,
    "op7_repeats": repeats.op7_repeats,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {**decontamination.SQL, **sharding.SQL, **repeats.SQL, **mixing.SQL, **line_dedup.SQL, **filter_audit.SQL, **merkle.SQL}
