"""Queries of conversion and segmentation with dictionaries that the tables themselves give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import segment
from siftwright.operators import convert, metrics, replay
from siftwright.plans.base import Catalog, table
from siftwright.plans.corpus import PAIRS
from siftwright.plans.records import BLEU

CATALOG = Catalog()
query = CATALOG.query

#: Entries: words of every fortieth document and a few groups of letters, which overlap with them.
GROUPS = {"th": "þ", "the": "ð", "er": "ê", "re": "r", "n e": "nē", "ción": "tion"}
GROWN = [" || ".join(["c", *[f"lead(c, {k}) OVER w" for k in range(1, n)]]) for n in range(1, 9)]
ENTRIES = f"""
entries AS (
  SELECT DISTINCT w AS source, '<' || left(w, 2) || '>' AS target FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{5,8}}')) AS w FROM documents WHERE doc_id % 40 = 0)
  UNION ALL SELECT unnest({list(GROUPS)}), unnest({list(GROUPS.values())})),
-- every place with its longest entry, and of these the ones that a reader from the left takes
chars AS (SELECT doc_id, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents)),
tried AS (SELECT doc_id, i, unnest(range(1, 9)) AS m, unnest([{', '.join(GROWN)}]) AS part FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, i, max(m) AS m, arg_max(target, m) AS target FROM tried JOIN entries ON source = part GROUP BY doc_id, i),
linked AS (SELECT a.doc_id, a.i, a.m, a.target, b.i AS nxt FROM places a ASOF LEFT JOIN places b ON a.doc_id = b.doc_id AND a.i + a.m <= b.i),
taken AS (
  SELECT * FROM linked SEMI JOIN (SELECT doc_id, min(i) AS i FROM places GROUP BY doc_id) USING (doc_id, i)
  UNION ALL SELECT l.* FROM taken t JOIN linked l ON l.doc_id = t.doc_id AND l.i = t.nxt)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    words = table(spark, sf_dir, "documents").filter("doc_id % 40 = 0").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,8}"), F.lit(0))).alias("source")).distinct()
    entries = words.withColumn("target", F.concat(F.lit("<"), F.left("source", F.lit(2)), F.lit(">")))
    return convert.read_dictionary(entries) | GROUPS


@query(f"""
WITH RECURSIVE {ENTRIES},
parts AS (SELECT doc_id, i, substr(text, coalesce(lag(i + m) OVER w, 1), i - coalesce(lag(i + m) OVER w, 1)) || target AS part, i + m AS stop FROM taken JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
made AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS head, max(stop) AS stop, count(*) AS n FROM parts GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN head IS NULL THEN text ELSE head || substr(text, stop) END) AS digest, length(CASE WHEN head IS NULL THEN text ELSE head || substr(text, stop) END) AS chars FROM documents LEFT JOIN made USING (doc_id)
""")
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the entries of a dictionary replaced, longest first, by its digest and length."""
    text = convert.converter({}, _dictionary(spark, sf_dir))(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query(f"""
WITH RECURSIVE {ENTRIES.split('-- every')[0].rstrip().rstrip(',')},
lines AS (SELECT doc_id, lang, k, line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) WHERE trim(line) <> ''),
hits AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k, line, i, unnest(range(2, 9)) AS m FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM lines)) JOIN entries ON source = substr(line, i, m))
SELECT lang, count(*) AS n_lines, round(100.0 * count(h.k) / count(*), 6) AS leak_pct FROM lines l LEFT JOIN hits h ON l.doc_id = h.doc_id AND l.k = h.k GROUP BY lang
""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language the share of lines that the conversion changes."""
    out = convert.leak_by_line(table(spark, sf_dir, "documents"), convert.converter({}, _dictionary(spark, sf_dir)), "lang", hyp="text")
    return out.withColumn("leak_pct", F.round("leak_pct", 6))


#: Forms of letters that their frequency decides: every third letter has another traditional form, every fifth a simplified one.
LETTERS = """
letters AS (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zà-öø-ÿ]')) AS c FROM documents) GROUP BY c),
leaks AS (SELECT coalesce(string_agg(c, ''), '') AS s FROM letters WHERE n % 3 = 0 AND n % 5 <> 0 AND c <> 'e')"""


def _leak_set(spark: SparkSession, sf_dir: str) -> str:
    """The characters that only simplified texts have: simplified already, with another traditional form, not allowed."""
    letters = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zà-öø-ÿ]"), F.lit(0))).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    traditional = convert.read_dictionary(letters.filter("n % 3 = 0").withColumn("target", F.concat("source", F.lit("'"))))
    simplified = convert.read_dictionary(letters.filter("n % 5 = 0").withColumn("target", F.lit("x")))
    return convert.simplified_only(simplified, traditional, allowed="e")


@query(f"WITH {LETTERS.strip()}\nSELECT lang, round(100.0 * avg((regexp_matches(translate(text, '0', ''), '[' || s || '0]'))::INT), 6) AS leak_pct FROM documents, leaks WHERE text IS NOT NULL GROUP BY lang")
def leaked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language the share of documents with a character of the leak set."""
    characters = _leak_set(spark, sf_dir)
    out = convert.leak_by_set(table(spark, sf_dir, "documents").filter("text is not null"), characters, "lang", hyp="text")
    return out.withColumn("leak_pct", F.round("leak_pct", 6))


@query(f"""
WITH {LETTERS.strip()},
parts AS (SELECT source, length(text) AS n, text FROM documents WHERE text IS NOT NULL),
old AS (SELECT source, 100.0 * avg((regexp_matches(translate(left(text, 200), '0', ''), '[' || s || '0]'))::INT) AS old FROM parts, leaks GROUP BY source),
new AS (SELECT source, 100.0 * avg((regexp_matches(translate(left(text, 100), '0', ''), '[' || s || '0]'))::INT) AS new FROM parts, leaks GROUP BY source)
SELECT source, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta FROM old JOIN new USING (source) WHERE abs(new - old) > 1e-9
""")
def rescored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak shares of stored openings of texts, scored again on shorter ones, where they differ."""
    characters = _leak_set(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    share = lambda n: convert.leak_by_set(docs.withColumn("t", F.left("text", F.lit(n))), characters, "source", hyp="t")
    out = convert.rescored(share(200), share(100), "source")
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("old", "new", "delta")])


#: Words of prompts and replies that occur three times or more, with costs; what they are cut from are the same texts without blanks.
TOKENS = f"""
sides AS MATERIALIZED (SELECT row_number() OVER () AS id, prompt, reply FROM ({PAIRS})),
vocabulary AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(prompt || ' ' || reply), '[a-zß-öø-ÿ]{{{{1,12}}}}')) AS w FROM sides) GROUP BY w HAVING count(*) >= 3),
costs AS (SELECT w, CAST(floor(1000 * ln((SELECT sum(n) FROM vocabulary) / n)) AS BIGINT) AS cost FROM vocabulary),
texts AS (SELECT id, 'h' AS side, regexp_replace(lower(reply), '[ \\n]', '', 'g') AS t FROM sides UNION ALL SELECT id, 'r', regexp_replace(lower(prompt), '[ \\n]', '', 'g') FROM sides),
pieces AS MATERIALIZED (SELECT row_number() OVER () AS k, id, side, j, p FROM (SELECT id, side, unnest(q) AS p, unnest(range(len(q))) AS j FROM (SELECT id, side, regexp_extract_all(t, '[^.,;:!?]+|[.,;:!?]') AS q FROM texts))),
starts AS (SELECT k, p, unnest(range(1, length(p) + 1)) AS i FROM pieces),
words AS (SELECT k, i, m, substr(p, i, m) AS w FROM (SELECT *, unnest(range(1, 13)) AS m FROM starts) WHERE i + m - 1 <= length(p)),
edges AS MATERIALIZED (SELECT k, i + m - 1 AS stop, list({{{{'m': m, 'c': CASE WHEN m = 1 THEN least(coalesce(cost, 20000), 20000) ELSE cost END}}}}) AS es FROM words LEFT JOIN costs USING (w) WHERE m = 1 OR cost IS NOT NULL GROUP BY k, i + m - 1),
-- the state of a piece: the place, the costs up to the last twelve places, the lengths of the last words of all paths
walk AS (
  SELECT k, 0::BIGINT AS t, [0::BIGINT] AS recent, []::BIGINT[] AS back FROM pieces
  UNION ALL
  SELECT k, t + 1, list_prepend(b[1], recent[1:11]), list_append(back, -b[2]) FROM (
    SELECT w.*, list_min(list_transform(es, lambda e: (recent[e.m] + e.c, -e.m))) AS b FROM walk w JOIN edges e ON e.k = w.k AND e.stop = w.t + 1)),
ends AS MATERIALIZED (SELECT w.k, id, side, j, p, back FROM walk w JOIN pieces q ON q.k = w.k AND w.t = length(q.p)),
cut AS (
  SELECT k, id, side, j, p, back, length(p) AS z FROM ends
  UNION ALL SELECT k, id, side, j, p, back, z - back[z] FROM cut WHERE z > 0),
tokens AS MATERIALIZED (SELECT id, side, list(substr(p, z - back[z] + 1, back[z]) ORDER BY j, z) AS w FROM cut WHERE z > 0 GROUP BY id, side)"""


def _segmenter(pairs: DataFrame) -> segment.Segmenter:
    words = pairs.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "prompt", "reply")), F.lit("[a-zß-öø-ÿ]{1,12}"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    return segment.Segmenter(segment.read_costs(segment.word_costs(counts)), 20_000, None)


def _unspaced(column: str):
    """Without blanks, but for those around marks, which no word holds."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[ \n]", ""), "([.,;:!?])", " $1 ")


@query(f"""
WITH RECURSIVE {TOKENS.format()},
p AS (SELECT id, max(w) FILTER (WHERE side = 'h') AS h, max(w) FILTER (WHERE side = 'r') AS r FROM tokens GROUP BY id),{BLEU}
""")
def bleu_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of replies beside prompts that lost their blanks, over the words of the cheapest path."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations"))
    cut = _segmenter(pairs)
    rows = pairs.select(segment.tokens_lattice(_unspaced("reply"), cut).alias("hyp_tokens"), segment.tokens_lattice(_unspaced("prompt"), cut).alias("ref_tokens"))
    return metrics.bleu(rows).select(F.round("bleu", 6).alias("bleu"))


@query(f"""
WITH RECURSIVE {TOKENS.format()}
SELECT c.conv_id, c.turn, CAST(len(h.w) AS INT) AS n_reply, md5(array_to_string(h.w, ' ')) AS reply, CAST(len(r.w) AS INT) AS n_prompt, md5(array_to_string(r.w, ' ')) AS prompt
FROM (SELECT row_number() OVER () AS id, conv_id, turn FROM ({PAIRS})) c LEFT JOIN tokens h ON h.id = c.id AND h.side = 'h' LEFT JOIN tokens r ON r.id = c.id AND r.side = 'r'
""")
def segmented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the pairs have without their blanks, and which."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations"))
    cut = _segmenter(pairs)
    rows = pairs.select("conv_id", "turn", segment.tokens_lattice(_unspaced("reply"), cut).alias("h"), segment.tokens_lattice(_unspaced("prompt"), cut).alias("r"))
    return rows.select("conv_id", "turn", F.size("h").alias("n_reply"), F.md5(F.array_join("h", " ")).alias("reply"), F.size("r").alias("n_prompt"), F.md5(F.array_join("r", " ")).alias("prompt"))
