"""Types of the document model, the single place they are written."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ENTRY = _struct(content=T.ArrayType(_S), lemma_content=T.ArrayType(_S), pos=T.ArrayType(_S), positions=T.ArrayType(T.IntegerType()), label=_S, **{"class": T.IntegerType()})
TRIPLE = _struct(subject=ENTRY, property=ENTRY, value=ENTRY, automatically_fill=T.BooleanType(), confidence=T.DoubleType(), weight=T.DoubleType(), field_type=_S)
DOCUMENT = _struct(data_source=_S, source_doc_id=_S, title=_S, content=T.ArrayType(_S), kg=T.ArrayType(TRIPLE), error=T.BooleanType())
TOKEN = _struct(pos=_S, lemma=_S, text=_S, is_oov=T.BooleanType(), is_sent_start=T.BooleanType(), position=T.IntegerType())
ENVELOPE = _struct(datatype=_S, data=_S, source=_S)
QREL = "qid bigint, iter int, docid string, rel int"
RUN = "qid bigint, q0 string, docid string, rank int, score double, run string"
