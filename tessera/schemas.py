"""Table schemas and key construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = "array<struct<source:string,document_id:string,chunk_id:string,confidence:double>>"

SCHEMAS = {
    "documents": "document_id string, filename string, title string, version string, date string, author string, page_count int, checksum string, file_path string, ingestion_status string, ingestion_error string, last_ingested_at timestamp, raw_text string",
    "chunks": "chunk_id string, document_id string, level int, parent_chunk_id string, hierarchy_path string, section_title string, content string, token_count long, entity_ids array<string>",
    "chunk_vectors": "chunk_id string, document_id string, level int, vec array<double>",
    "mentions": "name string, type string, description string, aliases array<string>, confidence double, chunk_id string, document_id string, source string, start_char int, end_char int, sentence string, context string",
    "entity_candidates": "id string, candidate_key string, canonical_name string, candidate_type string, aliases array<string>, description string, confidence_score double, status string, mention_count long, source_documents array<string>, chunk_ids array<string>, conflicting_types array<string>, provenance_events array<string>, first_seen timestamp, last_seen timestamp",
    "relationship_candidates": "id string, candidate_key string, source string, target string, type string, description string, confidence_score double, status string, mention_count long, source_documents array<string>, chunk_ids array<string>, provenance_events array<string>, first_seen timestamp, last_seen timestamp",
    "entities": "id string, canonical_name string, entity_type string, aliases array<string>, description string, confidence_score double, status string, mention_count long, source_documents array<string>, chunk_ids array<string>, candidate_key string, merged_candidate_keys array<string>",
    "relationships": "id string, type string, source_entity_id string, target_entity_id string, description string, confidence_score double, status string, source_documents array<string>, source_chunks array<string>",
    "normalization": "normalized_form string, raw_variants array<string>, canonical_id string, canonical_name string, entity_type string, method string, confidence double, version int, created_at timestamp, updated_at timestamp, notes string, source string, status string",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 identifier in the URL name space, from built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = lambda d: F.lower(F.hex(F.conv(F.substring(d, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = lambda d: F.concat_ws(
        "-",
        F.substring(d, 1, 8),
        F.substring(d, 9, 4),
        F.concat(F.lit("5"), F.substring(d, 14, 3)),
        F.concat(variant(d), F.substring(d, 18, 3)),
        F.substring(d, 21, 12),
    )
    return F.get(F.transform(F.array(digest), parts), F.lit(0))  # a lambda's argument is computed once, however long its expression


def key_fragment(value: Column) -> Column:
    """Lower-case letters and digits, everything else folded to one underscore; expects a normalised name."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def candidate_key(kind: Column, normalized: Column, fallback: Column) -> Column:
    fragment = key_fragment(normalized)
    return F.concat_ws(":", kind, F.when(fragment == "", fallback).otherwise(fragment))


def relationship_key(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws(":", key_fragment(source), kind, key_fragment(target))


def candidate_id(key: Column, kind: str = "entity") -> Column:
    return uuid5(F.concat(F.lit(f"{kind}_candidate:"), key))


def relationship_id(source_id: Column, kind: Column, target_id: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("relationship"), source_id, kind, target_id))


def chunk_id(document_id: Column, level: Column, path: Column) -> Column:
    """Stable over runs, unlike a random identifier."""
    return F.sha2(F.concat_ws(":", document_id, level.cast("string"), path), 256)


def approved_key(name: Column) -> Column:
    return F.lower(F.trim(name))
