"""Schemas of documents as they come in, and of the stored tables."""

from pyspark.sql import types as T


def _fields(names: str, **other: T.DataType) -> T.StructType:
    """Fields in the order of ``names``, strings but for those given another type."""
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in names.split()])


PEOPLE = T.ArrayType(_fields("name email org role"))

#: One incoming document.
RECORD = _fields("source kind external_id title occurred_at people orgs body raw owner", people=PEOPLE, orgs=T.ArrayType(T.StringType()))
DOCUMENTS = _fields("id source kind external_id title occurred_at raw body body_sha256 owner", occurred_at=T.TimestampType())
MENTIONS = _fields("id document_id kind name email org_hint role norm_name norm_email entity_id origin confidence context", confidence=T.DoubleType())
