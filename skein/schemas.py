"""Tables of the engine: columns, keys and partition columns. Schemas are given, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = "1.0.0"


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    partition: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


TABLES = {
    "documents": Table("ref string, namespace string, document_ref string, title string, media_type string, metadata map<string,string>", ("ref",), ("namespace", "document_ref")),
    "source_units": Table("namespace string, document_ref string, unit_ref string, fingerprint string, order_key string, text string, metadata map<string,string>", ("namespace", "document_ref", "unit_ref")),
    "chunks": Table("chunk_id string, chunk_strategy string, heading_hierarchy array<string>, level int, document_ref string, ref string, title string, tags_text string, text string, chunk_index int, file_paths array<string>, source_unit_refs array<string>", ("chunk_id",), ("text",), ("chunk_strategy",)),
    "provenance": Table("chunk_id string, namespace string, document_ref string, ref string, source_unit_refs array<string>, chunk_strategy string, parser_name string", ("chunk_id", "namespace", "document_ref")),
    "chunk_file_bindings": Table("chunk_id string, file_path string, chunk_index int", ("chunk_id", "file_path")),
    "bindings": Table("ref string, namespace string, resource_ref string, active boolean, bound_at timestamp, unbound_at timestamp, content_fingerprint string, meta_fingerprint string", ("ref",), ("active",)),
    "fingerprints": Table("fingerprint_id string, kind string, content_fingerprint string, meta_fingerprint string", ("fingerprint_id",)),
    "embeddings": Table("chunk_id string, chunk_strategy string, embedding_model string, text_hash string, vector_rowid long, vector array<float>", ("chunk_strategy", "embedding_model", "chunk_id"), ("text_hash",), ("chunk_strategy", "embedding_model")),
    "vector_components": Table("chunk_id string, chunk_strategy string, embedding_model string, component string, embedding array<float>", ("chunk_strategy", "embedding_model", "chunk_id", "component"), (), ("chunk_strategy", "embedding_model")),
    "nodes": Table("table string, id string", ("table", "id")),
    "relations": Table("relation_id string, source_table string, source_id string, target_table string, target_id string, rel_type string, weight double, properties map<string,string>", ("relation_id",)),
    "feedback": Table("id string, status string, severity string, message string, created_at timestamp, context string", ("id",), ("message",)),
    "cursors": Table("ref string, cursor string, last_success_at timestamp, last_error string", ("ref",)),
    "checkpoints": Table("namespace string, checkpoint_cursor string, updated_after string, updated_after_cursor string, last_success_at timestamp, last_error string", ("namespace",)),
    "stats": Table("name string, value long", ("name",)),
    "file_fingerprints": Table("file_path string, mtime double, size_bytes long, checksum string, indexed_at timestamp", ("file_path",)),
    "embedding_cache": Table("text_hash string, embedding_model string, vector array<float>", ("text_hash", "embedding_model")),
    "extraction_cache": Table("cache_key string, entities_json string, co_occurs_json string", ("cache_key",)),
    "commits": Table("stream string, batch_id long, phase string", ("stream", "batch_id", "phase")),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of the table, cast, in its order; missing ones null; others left out. Rows without key or required fields are an error."""
    from pyspark.sql import functions as F

    table = TABLES[name]
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    needed = [*table.key, *table.required]
    bad = F.lit(False)
    for c in needed:
        bad = bad | F.col(c).isNull()
    check = F.when(bad, F.raise_error(F.lit(f"{name}: a row lacks one of {', '.join(needed)}"))).otherwise(F.col(needed[0]))
    return out.withColumn(needed[0], check.cast(out.schema[needed[0]].dataType))


def differences(actual: T.StructType, name: str) -> list[str]:
    """What a stored schema has otherwise than the table: transformable (widening, missing optional), unsafe or unsupported changes."""
    out = []
    wanted = {f.name: f.dataType for f in TABLES[name].schema}
    held = {f.name: f.dataType for f in actual}
    for c, t in wanted.items():
        if c not in held:
            out.append(f"{'unsafe' if c in TABLES[name].key else 'transformable'}: {c} is missing")
        elif held[c] != t:
            wider = (held[c].simpleString(), t.simpleString()) in {("int", "bigint"), ("float", "double"), ("date", "timestamp")}
            out.append(f"{'transformable' if wider else 'unsupported'}: {c} is {held[c].simpleString()}, not {t.simpleString()}")
    return out + [f"transformable: {c} is extra" for c in held if c not in wanted]
