"""Queries of loops in texts. The SQL finds blocks without back-references: as runs of characters that equal a later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators import detect
from siftwright.plans.base import Catalog, table

CATALOG = Catalog()
query = CATALOG.query


def _equal_runs(low: int, high: int, where: str = "TRUE") -> str:
    """Rows (doc_id, size, i, n): from place i on, n characters in a row of `chars` equal the ones `size` places on."""
    shifts = ", ".join(f"c = lead(c, {k}) OVER w AND {where}" for k in range(low, high + 1))
    return f"""
same AS (SELECT doc_id, size, i FROM (SELECT doc_id, i, unnest(range({low}, {high + 1})) AS size, unnest([{shifts}]) AS e FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e),
runs AS (SELECT doc_id, size, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, size ORDER BY i) AS island FROM same) GROUP BY doc_id, size, island)"""


@query(f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents),
chars AS (SELECT doc_id, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '(?s).') AS c FROM t WHERE length(t) >= 16)),{_equal_runs(4, 24)},
blocks AS (SELECT doc_id, min((i, size)) AS b FROM runs WHERE n >= size GROUP BY doc_id),
grams AS (SELECT doc_id, i, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w || lead(c, 5) OVER w AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
thirds AS (SELECT doc_id, arg_min(g, i) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM grams WHERE g IS NOT NULL) WHERE k = 3 GROUP BY doc_id)
SELECT doc_id, CASE WHEN b IS NOT NULL THEN substr(t, b[1], b[2]) ELSE g END AS loop FROM t LEFT JOIN blocks USING (doc_id) LEFT JOIN thirds USING (doc_id)
""")
def document_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the first block that follows itself, else the first piece that comes three times."""
    return table(spark, sf_dir, "documents").select("doc_id", detect.repetition_loop(F.col("text")).alias("loop"))


@query(f"""
WITH RECURSIVE windows AS (SELECT doc_id, substr(text, i, 20) AS g, count(*) AS n FROM (SELECT doc_id, text, unnest(range(1, length(text) - 18)) AS i FROM documents WHERE length(text) >= 20) GROUP BY ALL),
top AS (SELECT doc_id, max(n) AS window_n FROM windows GROUP BY doc_id),
parts AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([。．.!?\\n])\\s*', '\\1' || chr(1), 'g'), chr(1))), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM documents),
sentences AS (SELECT doc_id, max(n) AS sentence_n FROM (SELECT doc_id, s, count(*) AS n FROM parts WHERE length(s) >= 8 GROUP BY ALL) GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, s, count(*) AS n FROM parts WHERE length(s) >= 12 GROUP BY ALL) WHERE n >= 3),
-- four equal blocks of twelve characters hold a window of twenty three times: no other text can have any
chars AS (SELECT doc_id, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents SEMI JOIN (SELECT doc_id FROM top WHERE window_n >= 3) USING (doc_id))),{_equal_runs(12, 80, "c <> chr(10)")},
spots AS (SELECT doc_id, i, min((size, n)) AS b FROM (SELECT doc_id, size, unnest(range(i, i + n - 3 * size + 1)) AS i, n - (unnest(range(i, i + n - 3 * size + 1)) - i) AS n FROM runs WHERE n >= 3 * size) GROUP BY doc_id, i),
taken AS (
  SELECT doc_id, min((i, i + b[1] * (1 + b[2] // b[1]))) AS s, 1 AS k FROM spots GROUP BY doc_id
  UNION ALL
  SELECT doc_id, min((i, i + b[1] * (1 + b[2] // b[1]))), any_value(k) + 1 FROM taken JOIN spots USING (doc_id) WHERE i >= s[2] GROUP BY doc_id),
blocks AS (SELECT doc_id, max(k) AS blocks FROM taken GROUP BY doc_id)
SELECT doc_id, CAST(greatest(coalesce(sentence_n, 0), coalesce(window_n, 0)) AS INT) AS max_phrase_count, CAST(coalesce(blocks, 0) AS INT) AS regex_multi_repeat
FROM documents LEFT JOIN top USING (doc_id) LEFT JOIN sentences USING (doc_id) LEFT JOIN blocks USING (doc_id)
WHERE length(text) >= 12 AND (coalesce(sentence_n, 0) >= 4 OR coalesce(window_n, 0) >= 8 OR coalesce(blocks, 0) > 0 OR doc_id IN (SELECT doc_id FROM long))
""")
def loop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents loop, and how often they say the same."""
    s = detect.loop_stats(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).filter("s.loop_flag").select("doc_id", "s.max_phrase_count", "s.regex_multi_repeat")
