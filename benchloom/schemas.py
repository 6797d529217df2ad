"""Explicit schemas of the stored layers.

Dynamic dictionaries are kept as JSON text at rest (``*_json``) and parsed to VARIANT
where an operator needs a key; hot keys get typed columns of their own.
"""

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TAGS = T.ArrayType(S)
TEXT_MAP = T.MapType(S, S)
OPTIONS = T.ArrayType(_struct(id=S, text=S))

PROMPTS = _struct(
    prompt_id=S, prompt=S, language=S, negative_prompt=S,
    parameters=T.VariantType(), metadata=T.VariantType(), version=S,
)
CASES = _struct(
    benchmark_id=S, case_id=S, case_version=S, input_modality=S, input_payload=T.VariantType(),
    metadata=T.VariantType(), tags=TAGS, split=S, source_builder=S, grouping=TEXT_MAP,
    execution_hints=T.VariantType(), evaluation_hints=T.VariantType(), language=S,
    parameters=T.VariantType(), prompt=S, instruction=S, context=S,
    expected_output_contract=S, expected_structure=S,
)
TARGET_RESULTS = _struct(
    task_id=S, request_id=S, benchmark_id=S, case_id=S, target_model=S, source_run_id=S,
    source_record_id=S, split=S, tags=TAGS, artifact_type=S, artifact_path=S, prompt=S,
    execution_status=S, response_text=S, metadata=T.VariantType(), prompt_metadata=T.VariantType(),
)
NORMALIZED = _struct(
    request_id=S, case_id=S, target_model=S, source_run_id=S, source_record_id=S, split=S,
    normalizer_id=S, status=S, decision_text=S, refusal_flag=B, confidence_value=D,
    confidence_label=S, reasoning_trace_text=S,
)
SCORES = _struct(
    request_id=S, case_id=S, target_model=S, source_run_id=S, source_record_id=S, split=S,
    scorer_id=S, status=S, labels=TAGS, scores=T.MapType(S, D), rationale=S, raw_judgment=T.VariantType(),
)
ANNOTATIONS = _struct(
    annotation_id=S, source_run_id=S, source_record_id=S, source_model_name=S,
    source_artifact_type=S, annotator_model=S, annotation_status=S, annotation=T.VariantType(),
)
LEDGER = _struct(
    event_id=L, ts=T.TimestampType(), run_id=S, task_id=S, replica_id=L, model_name=S,
    prompt_id=S, status=S, artifact_type=S, artifact_path=S, artifact_count=L,
    error_message=S, failure_category=S,
)
DATASET = _struct(
    record_id=S, run_id=S, task_id=S, prompt_id=S, prompt=S, negative_prompt=S, language=S,
    model_name=S, artifact_type=S, artifact_path=S, split=S, status=S,
)
EXPERIMENT_LOG = _struct(
    event_id=S, ts=T.TimestampType(), experiment_id=S, task_id=S, stage=S, entity_type=S,
    entity_id=S, status=S, payload=T.VariantType(),
)

LAYERS = {
    "prompts": PROMPTS, "cases": CASES, "target_results": TARGET_RESULTS,
    "normalized_results": NORMALIZED, "score_records": SCORES, "annotations": ANNOTATIONS,
    "ledger": LEDGER, "dataset_records": DATASET, "experiment_log": EXPERIMENT_LOG,
}
