"""SQL of the queries that SQL can express."""

_LIMITS = """
    SELECT u.unit_id, u.state, greatest(coalesce(s.max_unit_tokens, 24000), 1) AS lim, greatest(coalesce(s.overlap_tokens, 0), 0) AS ovl
    FROM units u
    LEFT JOIN (SELECT file_id, max(settings_id) AS settings_id FROM files GROUP BY 1) f USING (file_id)
    LEFT JOIN (SELECT settings_id, max(max_unit_tokens) AS max_unit_tokens, max(overlap_tokens) AS overlap_tokens FROM settings GROUP BY 1) s USING (settings_id)
    WHERE u.state IS NOT NULL AND u.unit_id IS NOT NULL
"""

ORACLE_SQL = {
    "p5_cover": f"""
        WITH over AS (SELECT DISTINCT * FROM ({_LIMITS}) WHERE length(state) // 4 + 1 > lim)
        SELECT unit_id, CAST(0 AS BIGINT) AS first_char, length(state) AS chars, CAST(least(4 * ovl, 4 * lim - 2) AS BIGINT) AS least_overlap, CAST(least(4 * ovl, 4 * lim - 2) AS BIGINT) AS most_overlap, true AS as_said, true AS fits, true AS enough
        FROM over
    """,
    "p5_found": f"""
        WITH over AS (SELECT DISTINCT * FROM ({_LIMITS}) WHERE length(state) // 4 + 1 > lim)
        SELECT unit_id,
               CAST(max(CASE WHEN list_max(list_transform(regexp_split_to_array(state, '[\\s.!?。！？।؟…]'), lambda x: length(x))) > 4 * lim - 1 THEN 1 ELSE 0 END) AS INTEGER) AS forced_cut
        FROM over GROUP BY 1
    """,
}
