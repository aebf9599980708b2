"""Column types of the evaluation tables, for reading files without inference."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "projects": "id long, name string, slug string, description string, created_at double, deleted_at double",
    "images": "id long, project_id long, sha256 string, filename string, stored_path string, source_group string, mime string, width int, height int, split string, created_at double, deleted_at double",
    "questions": "id long, project_id long, key string, label string, description string, created_at double",
    "variants": "id long, question_id long, name string, language string, text string, mutation_type string, canonical boolean, created_at double",
    "annotation_labels": "id long, image_id long, question_id long, annotator string, value string, note string, is_adjudication boolean, updated_at double",
    "providers": "id long, name string, kind string, endpoint string, model string, is_demo boolean, created_at double",
    "runs": "id long, project_id long, provider_id long, name string, status string, config struct<question_ids:array<long>,variant_ids:array<long>,split:string,repetitions:int,temperature:double,seed:long,max_tokens:int,timeout:int>, total int, completed int, error string, runtime_seconds double, created_at double, started_at double, finished_at double, memory_bytes long, memory_vram_bytes long, memory_sampled_at double, archived_at double",
    "responses": "id long, run_id long, image_id long, variant_id long, repetition int, answer string, raw string, format_valid boolean, parser string, latency_ms double, prompt_tokens int, completion_tokens int, prompt_text string, error string, input_sha256 string, input_mime string, input_width int, input_height int, input_preprocess string, created_at double",
    "image_features": "image_id long, extractor_version string, brightness double, contrast double, edge_density double, saturation double, phash string, analyzed_at double",
}
