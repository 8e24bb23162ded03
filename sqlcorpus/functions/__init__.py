from sqlcorpus.functions.text import (
    duration_text,
    join_present,
    processed_name,
    prompt,
    requote,
    run_label,
    scale_step,
    sql_text,
    table_name,
    tagged_sections,
)

__all__ = [
    "duration_text", "join_present", "processed_name", "prompt", "requote",
    "run_label", "scale_step", "sql_text", "table_name", "tagged_sections",
]
