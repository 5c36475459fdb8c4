"""Column lists of the stored tables, as schema strings."""

from __future__ import annotations

#: Names and types that existing tables have.
TABLES = {
    "agents": "id string, name string, agent_type string, capabilities string, metadata string, is_active boolean, created_at timestamp, last_seen_at timestamp",
    "sessions": "id string, agent_id string, parent_session_id string, goal string, status string, summary string, source_key string, embedding array<float>, metadata string, started_at timestamp, ended_at timestamp",
    "memories": "id string, agent_id string, session_id string, content string, content_type string, embedding array<float>, importance double, tags array<string>, metadata string, last_accessed_at timestamp, access_count int, decay_score double, storage_tier string, created_at timestamp, updated_at timestamp",
    "documents": "id string, path string, vault_section string, title string, content string, checksum string, frontmatter string, embedding array<float>, token_count int, file_size_bytes int, file_modified_at timestamp, storage_tier string, created_at timestamp, updated_at timestamp",
    "experiences": "id string, agent_id string, session_id string, goal string, reasoning_summary string, actions string, files_changed string, result string, lessons_learned string, confidence double, duration_seconds int, tags array<string>, related_project string, embedding array<float>, is_procedurized boolean, created_at timestamp, updated_at timestamp",
    "procedures": "id string, name string, description string, steps string, times_used int, success_rate double, created_at timestamp, updated_at timestamp",
    "trading_results": "id string, agent_id string, session_id string, strategy string, symbol string, notes string, pnl double, embedding array<float>, created_at timestamp",
    "contradictions": "id string, memory_a string, memory_b string, content_a string, content_b string, similarity double, signals int, resolved boolean, created_at timestamp",
    "embeddings": "source_table string, source_id string, embedding array<float>, updated_at timestamp",
    "access_log": "session_id string, source_table string, source_id string, interaction_type string, relevance_score double, accessed_at timestamp",
}
