"""Schemas of the persisted tables. List order is data, so every table carries its keys."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _d, _b = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGES = _struct(doc_id=_s, page_number=_i, text=_s, char_count=_i, source=_s, warnings=T.ArrayType(_s))
CHUNKS = _struct(doc_id=_s, ordinal=_i, id=_s, text=_s, page_start=_i, page_end=_i, article=_s, title=_s, embedding=T.ArrayType(_d))
EVIDENCE = _struct(article=_s, page=_s)
CASES = _struct(
    ordinal=_i, id=_s, question=_s, category=_s, difficulty=_s, answerable=_b,
    expected_citations=T.ArrayType(EVIDENCE), expected_keywords=T.ArrayType(_s), expected_answer_points=T.ArrayType(_s),
)
COUNTS = _struct(dl=T.LongType(), terms=T.ArrayType(_s), tf=T.ArrayType(_i))
STORED = T.StructType([*CHUNKS.fields, *COUNTS.fields, *_struct(block=T.LongType(), at=_i).fields])
GONE = _struct(doc_id=_s, block=T.LongType(), at=_i, dl=T.LongType(), terms=T.ArrayType(_s))
INDEX_META = _struct(
    pdf=_s, ocr_lang=_s, ocr_dpi=_i, embedding_provider=_s, embedding_model=_s, chunk_size=_i, overlap=_i,
    created_at=_s, chunk_count=T.LongType(),
)
