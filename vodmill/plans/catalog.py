"""Loads every module that registers queries, and gives each column function a query of its own."""

from . import analytics_queries, candidate_queries, library_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL, derive

derive("s1_s4_parse_fields", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {
    "s1_first_value": ["first_value"], "s2_csv_number": ["csv_number", "csv_negative"], "s3_normalize_date": ["day_us", "day_iso"], "s4_duration_to_seconds": ["mmss", "hhmmss"],
})
derive("s5_s13_classify_fields", ["event_id"], {
    "s5_stream_position": ["position"], "s6_watch_minutes": ["minutes"], "s7_content_type": ["content_type"], "s8_live_or_on_demand": ["mode"], "s9_lenient_long": ["whole"],
    "s10_rpm": ["rpm"], "s11_percent_delta": ["delta"], "s12_iso8601_duration": ["iso_seconds"], "s13_parse_datetime": ["epoch"],
})
derive("s14_s16_time_tags_score", ["candidate_window_id"], {
    "s14_timestamps": ["stamp", "back", "label"], "s15_normalize_tags": ["tags"], "s16_weighted_score": ["weighted_score"],
})
derive("s19_s20_f8_pillars", ["doc_id"], {"s19_normalize_pillar": ["named"], "s20_infer_pillar": ["inferred"], "f8_is_refusal": ["refused"]})
derive("s22_s24_calibrate", ["candidate_window_id"], {
    "s22_calibrate_scores": ["pillar_relevance", "hook_strength", "standalone_clarity", "confidence"], "s23_candidate_risks": ["risks"], "s24_window_type_chatter": ["window_type", "chatter"],
})
derive("s25_s26_local_review", ["candidate_window_id"], {
    "s25_flags_recommendation": ["flags", "recommendation"], "s26_structured_scores": ["standalone_clarity", "confidence", "hook_strength", "emotional_impact"],
})
derive("s28_s31_identities", ["p_partkey"], {"s28_identity_hashes": ["fingerprint", "config", "generation"], "s31_artifact_path": ["path"]})
derive("s29_s30_vector_codec", ["vec_id"], {"s29_vector_codec": ["dim", "same"], "s30_l2_normalize": ["norm", "unit"]})
