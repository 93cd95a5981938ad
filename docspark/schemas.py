"""Record types of the data model."""

from pyspark.sql import types as T

# The registry's 24 fields in order, and the status domains.
REGISTRY_FIELDS = [
    "source_id", "content_hash", "filename", "ext", "nature", "origin_path", "canonical_path", "extracted_path", "size_bytes", "modified_time", "last_seen_time",
    "extraction_status", "extraction_error", "last_extracted_time", "chunk_status", "nb_chunks", "chunk_config_hash", "chunk_error", "last_chunk_time",
    "index_status", "indexed_chunks", "index_config_hash", "index_error", "last_index_time",
]
CHUNK_FIELDS = ["chunk_status", "nb_chunks", "chunk_config_hash", "chunk_error", "last_chunk_time"]
INDEX_FIELDS = ["index_status", "indexed_chunks", "index_config_hash", "index_error", "last_index_time"]
EXTRACTION_FIELDS = ["extracted_path", "extraction_error", "last_extracted_time"]
NEW, EXTRACTED, FAILED, MISSING = "NEW", "EXTRACTED", "FAILED", "MISSING"
PENDING, CHUNKED, INDEXED = "PENDING", "CHUNKED", "INDEXED"

REGISTRY = T.StructType([T.StructField(f, T.StringType()) for f in REGISTRY_FIELDS])
