"""Schemas of the tables that cross the engine's edge."""

SEGMENT = "id int, start double, `end` double, text string, original_text string, timestamp_label string"
TRANSCRIPT = f"video_id string, metadata struct<source_file:string, language_detected:string, model_used:string, processed_at:string>, full_text string, original_full_text string, segments array<struct<id:int, start:double, `end`:double, text:string, original_text:string, timestamp_label:string>>"
CONCEPT_REPLY = "domain string, concepts array<struct<name:string, normalized_name:string, importance_score:double, difficulty:string, description:string>>"
RELATION_REPLY = "relationships array<struct<`from`:string, `to`:string, confidence:double, evidence:string>>"
EDGE = "video_id string, src string, dst string, relation string, confidence double, evidence string, timestamp string, detection_method string"
