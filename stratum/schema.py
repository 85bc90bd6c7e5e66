"""Table schemas and limits of the memory store."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DRAWERS = _struct(
    id=S, wing=S, room=S, source_file=S, chunk_index=L, added_by=S, filed_at=T.TimestampType(), content=S, hall=S, date=S,
    drawer_type=S, source_hash=S, active=B, importance=D, emotional_weight=D, weight=D,
)
REVISIONS = _struct(source_file=S, source_hash=S, updated_at=T.TimestampType())
VECTORS = _struct(drawer_id=S, embedding=T.ArrayType(T.FloatType()), backend=S)
ENTITIES = _struct(id=S, name=S, type=S, properties=S, created_at=T.TimestampType())
TRIPLES = _struct(
    id=S, subject=S, predicate=S, object=S, valid_from=S, valid_to=S, confidence=D, source_closet=S, source_file=S, extracted_at=T.TimestampType(),
)

# limits (fixed values)
MAX_FILE_BYTES = 512 * 1024
MAX_FILE_CHARS = 200_000
MAX_DATASET_BYTES = 2 * 1024 * 1024
MAX_DATASET_DOCS = 5_000
MAX_MESSAGE_BYTES = 1024 * 1024
MAX_QUERY_CHARS = 2_000
VECTOR_DIM = 512
ARTIFACT_OFFSET = 10_000

# chunking (fixed values)
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 800, 100, 50
MIN_CHAT_CHUNK = 30
GROUP_LINES = 25

DRAWER, DIARY = "drawer", "diary_entry"
DEFAULT_IMPORTANCE = 3.0
