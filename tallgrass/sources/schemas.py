"""Declared schemas; nothing is inferred from JSON."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


ITEMS = _struct(id=_L, question=_S, options=T.ArrayType(_S), answer=T.ArrayType(_S))
RESPONSES = _struct(id=_L, response=_S)
RESULTS = _struct(id=_L, is_mcq=_B, gold=T.ArrayType(_S), response=_S, correct=_S)
SAMPLES = _struct(id=_L, sample_idx=_I, tag=_S, prompt_tag=_S, text=_S, finish_reason=_S)
CORPUS = _struct(
    source=_S, source_id=_S, task_type=_S, topic=_S, hf_source=_S, weak_topic=_B, question=_S, options=T.ArrayType(_S), answer=_S, response=_S, trace_chars=_I, template_tokens=_I,
    thinking_template=_S, pass_rate_72b_tir=_D, supplement_mode=_S, blank_count=_I, composed_from=T.ArrayType(_S),
)
REJECTS = _struct(source=_S, source_id=_S, reason=_S, question_preview=_S, solution_preview=_S, response_tail=_S, trace_chars=_I, template_tokens=_I, pass_rate=_D)
GENERATIONS = _struct(problem=_S, generations=T.ArrayType(_S), correctness_math_verify=T.ArrayType(_B))
TURN = T.StructType([T.StructField("from", _S), T.StructField("value", _S), T.StructField("info", _struct(category=_S, source=_S, answer_content=_S, verify_score=_D))])
CONVERSATIONS = _struct(conversations=T.ArrayType(TURN))
CHOICES = _struct(query=_S, choices=T.ArrayType(_S), gold=T.ArrayType(_I))
