"""Queries of the corpus build: cleaning, documents, quotas, splits, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.operators import clean, curate, metrics, replay
from siftwright.plans.base import Catalog, h32_sql, table
from siftwright.sources import readers

CATALOG = Catalog()
query = CATALOG.query

MARKS = "'" + "', '".join(K.TERMINAL.replace("'", "''")) + "'"
ENDED = lambda c: f"(right({c}, 1) IN ({MARKS}))"
LINES = "SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS lineno, unnest(string_split(text, chr(10))) AS line FROM documents"
PAIRS = """SELECT conv_id, turn, text AS prompt, reply FROM (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role IN ('user', 'prompter') AND next_role = 'assistant'"""


@query(f"""
WITH eval AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark),
marked AS (SELECT l.lang, l.line, CASE WHEN trim(l.line) = '' THEN 'empty' WHEN e.line IS NOT NULL THEN 'eval_contaminated' END AS reason,
  row_number() OVER (PARTITION BY lang, l.line, trim(l.line) = '' OR e.line IS NOT NULL ORDER BY doc_id, lineno) AS rn
  FROM ({LINES}) l LEFT JOIN eval e ON l.line = e.line)
SELECT lang, coalesce(reason, CASE WHEN rn > 1 THEN 'dup' ELSE 'kept' END) AS reason, count(*) AS n FROM marked GROUP BY ALL
""")
def line_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many text lines survive cleaning, and why were the rest dropped? Copies are counted, not ranked: the counts
    of equal lines combine before the shuffle, so a line in very many documents costs one row for each task."""
    lines = clean.split_lines(table(spark, sf_dir, "documents"), "text", "lang")
    evaluation = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    marked = clean.clean_lines(lines, evaluation)
    folded = marked.groupBy("lang", "line", "_early").agg(F.count("*").alias("n"))
    kept = F.struct(F.lit("kept").alias("reason"), F.lit(1).cast("long").alias("n"))
    dup = F.struct(F.lit("dup").alias("reason"), (F.col("n") - 1).alias("n"))
    parts = F.when(F.col("_early").isNotNull(), F.array(F.struct(F.col("_early").alias("reason"), F.col("n")))).otherwise(F.array(kept, dup))
    return folded.select("lang", F.explode(parts).alias("p")).select("lang", "p.*").filter("n > 0").groupBy("lang", "reason").agg(F.sum("n").alias("n"))


STRAY_SQL = r"[A-Za-z0-9一-鿿][ ]+[_/?=:%&][ ]?|[_/?=][ ]+[A-Za-z0-9一-鿿]"


@query(f"""
WITH p AS ({PAIRS}), m AS (SELECT prompt AS a, reply AS b, length(prompt) AS la, length(reply) AS lb FROM p)
SELECT CASE WHEN a = '' OR b = '' THEN 'empty' WHEN a = b THEN 'identical'
  WHEN (la >= 6 AND la % 2 = 0 AND left(a, la // 2) = right(a, la // 2)) OR (lb >= 6 AND lb % 2 = 0 AND left(b, lb // 2) = right(b, lb // 2)) THEN 'subtitle_noise'
  WHEN {ENDED('a')} <> {ENDED('b')} THEN 'punct_asymmetric'
  WHEN regexp_matches(a, '{STRAY_SQL}') OR regexp_matches(b, '{STRAY_SQL}') THEN 'stray_space'
  WHEN least(la, lb) < 3 OR greatest(la, lb) > 1000 THEN 'length'
  WHEN greatest(la, lb) / least(la, lb) > 3.0 THEN 'ratio' ELSE 'kept' END AS reason, count(*) AS n
FROM m GROUP BY ALL
""")
def pair_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of user and assistant turns as pairs."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations")).select(F.col("prompt").alias("a"), F.col("reply").alias("b"))
    return clean.reason_counts(clean.pair_reasons(pairs).withColumn("corpus", F.lit("conversations")), "corpus").drop("corpus")


@query("""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}]', '', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g'))) AS sha FROM documents""")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text of every document (no wide gaps there), by its digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("sha"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contaminated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a whole benchmark item."""
    return containing(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")))


def containing(docs: DataFrame, items: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that contain an item (item_id, item): they meet by words, then as a whole.

    An item's first and last word can touch other characters in a document; up to four words after the first stand
    there as they are and are a key, so this is an equi join. Items without such a word are searched in all documents,
    in broadcast blocks of about block_bytes.
    """
    keyed = items.withColumn("key", F.regexp_extract("item", r"^\s*\S+\s+(\S+(?:\s+\S+){0,3})\s+\S", 1))
    long, short = keyed.filter("key <> ''"), keyed.filter("key = ''").select("item_id", "item")
    sizes = [r["n"] for r in long.select(F.regexp_count("key", F.lit(r"\S+")).alias("n")).distinct().collect()]  # one to four
    runs = [F.regexp_extract_all("text", F.lit(rf"(?<!\S)(?=(\S+(?:\s+\S+){{{n - 1}}}))"), F.lit(1)) for n in sizes] or [F.array().cast("array<string>")]
    # only ids and keys are exploded; texts come back for the candidates
    windows = docs.select("doc_id", F.explode(F.flatten(F.array(*runs))).alias("key"))
    near = windows.join(long.select("key").distinct(), "key", "left_semi").distinct().join(long, "key").select(F.col("doc_id").alias("near_id"), "item_id", "item")
    out = docs.join(near, F.col("doc_id").eqNullSafe(F.col("near_id"))).filter(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    total = short.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for i in range(blocks):
        block = F.broadcast(short.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == i))
        out = out.unionByName(docs.join(block, F.col("text").contains(F.col("item"))).select("doc_id", "item_id"))
    return out


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text. The least (id, language) of a digest combines before the shuffle; no text travels."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "lang")).alias("m")).select("m.doc_id", "m.lang")


ISLANDS = f"SELECT doc_id, lineno, line, lineno - row_number() OVER (PARTITION BY doc_id ORDER BY lineno) AS island FROM ({LINES}) WHERE {ENDED('line')}"


@query(f"SELECT doc_id, island, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY lineno) AS text FROM ({ISLANDS}) GROUP BY doc_id, island HAVING count(*) >= 4")
def doc_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four terminated lines."""
    lines = clean.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    runs = curate.islands(lines, "doc_id", sides=("line",))
    return runs.groupBy("doc_id", "island").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("text")).filter("n_lines >= 4")


@query(f"""
WITH RECURSIVE runs AS (SELECT doc_id, island, count(*) AS n, list(line ORDER BY lineno) AS lines FROM ({ISLANDS}) GROUP BY doc_id, island HAVING count(*) >= 4),
cut AS (
  SELECT doc_id, island, n, lines, 0 AS part, 0 AS pos, least({h32_sql('42', 'doc_id', 'island', '0')} % 13 + 4, n) AS take FROM runs
  UNION ALL
  SELECT doc_id, island, n, lines, part + 1, CAST(pos + take AS INTEGER), least({h32_sql('42', 'doc_id', 'island', 'pos + take')} % 13 + 4, n - pos - take) FROM cut WHERE n - pos - take >= 4)
SELECT doc_id, island, part, take AS n_lines, sha256(array_to_string(lines[pos + 1 : pos + take], chr(10))) AS sha FROM cut
""")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 4 to 16 lines cut from runs of terminated lines."""
    lines = clean.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    docs = curate.build_documents(lines, "doc_id", sides=("line",))
    return docs.select("doc_id", "island", "part", "n_lines", F.sha2("line", 256).alias("sha"))


@query(f"""
WITH p AS (SELECT conv_id, turn, sha256(concat_ws('|', 42, conv_id, turn)) AS o FROM ({PAIRS})),
r AS (SELECT *, row_number() OVER (ORDER BY o) AS rn, count(*) OVER () AS n FROM p)
SELECT conv_id, turn, CASE WHEN rn <= n // 2 THEN 'user' ELSE 'assistant' END AS src_lang FROM r
""")
def direction_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the pairs in each direction, by hashed order."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("prompt").alias("a"), F.col("reply").alias("b"), F.lit("user").alias("lang_a"), F.lit("assistant").alias("lang_b"), F.lit("conversations").alias("corpus"))
    return curate.direction_halves(pairs, F.concat_ws("|", "conv_id", "turn"), "corpus").select("conv_id", "turn", "src_lang")


@query("""
WITH RECURSIVE pools AS (SELECT lang, source, count(*) AS ceiling, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS ord FROM documents GROUP BY lang, source),
sorted AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ceiling, ord) AS k, count(*) OVER (PARTITION BY lang) AS n FROM pools),
fill AS (
  SELECT lang, source, k, n, greatest(0, least(100 // n, ceiling)) AS take, 100 - greatest(0, least(100 // n, ceiling)) AS rest FROM sorted WHERE k = 1
  UNION ALL
  SELECT s.lang, s.source, s.k, s.n, greatest(0, least(f.rest // (s.n - s.k + 1), s.ceiling)), f.rest - greatest(0, least(f.rest // (s.n - s.k + 1), s.ceiling)) FROM fill f JOIN sorted s ON s.lang = f.lang AND s.k = f.k + 1)
SELECT lang, source, CAST(take AS BIGINT) AS take FROM fill
""")
def quota_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 100 documents for each language over its sources."""
    from pyspark.sql import Window

    pools = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("ceiling"))
    pools = pools.withColumn("ord", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("budget", F.lit(100))
    return curate.waterfill(pools, "lang").select("lang", "source", "take")


@query("""
WITH RECURSIVE pools AS (SELECT lang, source, count(*) AS ceiling, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS ord FROM documents GROUP BY lang, source),
sorted AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ceiling, ord) AS k, count(*) OVER (PARTITION BY lang) AS n FROM pools),
fill AS (
  SELECT lang, source, k, n, greatest(0, least(100 // n, ceiling)) AS take, 100 - greatest(0, least(100 // n, ceiling)) AS rest FROM sorted WHERE k = 1
  UNION ALL
  SELECT s.lang, s.source, s.k, s.n, greatest(0, least(f.rest // (s.n - s.k + 1), s.ceiling)), f.rest - greatest(0, least(f.rest // (s.n - s.k + 1), s.ceiling)) FROM fill f JOIN sorted s ON s.lang = f.lang AND s.k = f.k + 1),
ranked AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat_ws('|', 42, doc_id))) AS rn FROM documents)
SELECT r.doc_id, r.lang, r.source FROM ranked r JOIN fill f USING (lang, source) WHERE r.rn <= f.take
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that fill those quotas, by hashed order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pool = curate.hash_ranks(docs, 42, F.col("doc_id"), "lang", "source")
    return curate.take_quota(pool, quota_waterfill(spark, sf_dir), "lang", "source").select("doc_id", "lang", "source")


@query(f"""SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id % 3 ORDER BY sha256(concat_ws('|', 42, conv_id, turn))) <= 20 THEN 'dev' ELSE 'train' END AS part FROM ({PAIRS})""")
def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pairs of each of three groups as dev, by hashed order."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations")).withColumn("g", F.col("conv_id") % 3)
    return curate.dev_split(pairs, F.concat_ws("|", "conv_id", "turn"), "g", n=20).select("conv_id", "turn", "part")


@query(f"SELECT a.conv_id, a.turn FROM ({PAIRS}) a WHERE NOT EXISTS (SELECT 1 FROM ({PAIRS}) b WHERE b.conv_id % 5 = 0 AND a.prompt = b.prompt AND a.reply = b.reply)")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are not in a frozen set (those of every fifth conversation)."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations"))
    return curate.hold_out(pairs, pairs.filter("conv_id % 5 = 0"), "prompt", "reply").select("conv_id", "turn")


@query("""
WITH nodes AS (SELECT *, CASE WHEN (conv_id + turn) % 4 = 0 THEN NULL ELSE (conv_id * 7 + turn) % 5 END AS rank FROM conversations),
replies AS (SELECT n.conv_id, n.turn AS reply_turn, n.turn - n.turn % 2 - CASE WHEN n.turn % 2 = 0 THEN 2 ELSE 0 END AS parent, coalesce(n.rank, 99) AS rank FROM nodes n WHERE n.role = 'assistant'),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY rank, conv_id * 1000 + reply_turn) AS rn FROM replies)
SELECT p.conv_id || '-' || p.turn AS message_id, b.conv_id || '-' || b.reply_turn AS reply_id FROM conversations p JOIN best b ON p.conv_id = b.conv_id AND p.turn = b.parent AND b.rn = 1 WHERE p.role = 'user'
""")
def best_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked reply of each prompt; parents are the even turns before a reply, ranks are made from ids."""
    c = table(spark, sf_dir, "conversations")
    parent = F.col("turn") - F.col("turn") % 2 - F.when(F.col("turn") % 2 == 0, 2).otherwise(0)
    name = lambda t: F.concat_ws("-", "conv_id", t)
    nodes = c.select(
        name("turn").alias("message_id"), F.when(F.col("role") == "assistant", name(parent)).alias("parent_id"), F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), "text", F.lit("en-GB").alias("lang"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 != 0, (F.col("conv_id") * 7 + F.col("turn")) % 5).cast("int").alias("rank"), F.lit(False).alias("deleted"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )
    return replay.best_replies(nodes).select("message_id", "reply_id")


@query(f"SELECT conv_id, turn, length(prompt) AS n_prompt, length(reply) AS n_reply FROM ({PAIRS})")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns followed by assistant turns."""
    return replay.turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.length("prompt").cast("long").alias("n_prompt"), F.length("reply").cast("long").alias("n_reply"))


@query(f"""
WITH p AS (SELECT *, trim(prompt) AS q, trim(reply) AS r FROM ({PAIRS}))
SELECT CASE WHEN regexp_matches(lower(prompt), 'translat') THEN 'drop_translation_prompt' WHEN length(q) NOT BETWEEN 10 AND 4000 OR length(r) NOT BETWEEN 10 AND 4000 THEN 'drop_clean' ELSE 'kept' END AS reason,
  count(*) AS n, count(DISTINCT prompt) AS n_prompts FROM p GROUP BY ALL
""")
def replay_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the pairs as instruction records."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations")).select(F.lit("en").alias("lang"), "prompt", "reply", F.col("prompt").alias("raw"))
    return replay.emit(pairs).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_prompts"))


@query(f"""SELECT prompt, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY conv_id, turn) AS rn FROM ({PAIRS})) WHERE rn = 1""")
def distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pair of each prompt."""
    pairs = replay.turn_pairs(table(spark, sf_dir, "conversations")).withColumn("lang", F.lit("en"))
    return replay.distinct_prompts(pairs, F.struct("conv_id", "turn")).select("prompt", "conv_id", "turn")


@query("""
WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)
SELECT vec_id, round(c, 6) AS score FROM s WHERE c >= 0.0
""")
def cosine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector is at least as near to the first vector as the bound; scores are rounded for display."""
    e = table(spark, sf_dir, "embeddings")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.crossJoin(F.broadcast(first)).select("vec_id", metrics.cosine(F.col("embedding"), F.col("q")).alias("c"))
    return scored.filter("c >= 0").select("vec_id", F.round("c", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE quality_score(doc_id) >= 0.65".replace("quality_score(doc_id)", f"({h32_sql('7', 'doc_id')} % 1000) / 1000.0"))
def alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an alignment score of 0.65 or more; scores are made from ids and cover all rows."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("lineno"))
    scores = docs.withColumn("score", F.pmod(T.h32(7, F.col("lineno")), F.lit(1000)) / 1000.0)
    return curate.alignment_filter(docs, scores).select(F.col("lineno").alias("doc_id"))


@query(f"""
SELECT doc_id, 'system' AS r0, CASE {h32_sql('42', 'doc_id')} % 3 WHEN 0 THEN '翻譯成英文：' WHEN 1 THEN 'Translate to English:' ELSE '英語に翻訳してください：' END || chr(10) || source AS c1, lang AS c2 FROM documents
""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records with an instruction chosen by hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("en").alias("tgt_lang"), F.col("source").alias("src"), F.col("lang").alias("tgt"))
    m = F.col("messages")
    return curate.chat_records(rows, F.col("doc_id")).select("doc_id", m[0]["role"].alias("r0"), m[1]["content"].alias("c1"), m[2]["content"].alias("c2"))


@query("SELECT lang, count(*) AS got, 400 AS want FROM documents GROUP BY lang HAVING count(*) < 400 * 0.98")
def short_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with fewer documents than wanted."""
    got = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("got")).withColumn("want", F.lit(400))
    return curate.short_falls(got)


@query("SELECT doc_id FROM documents ORDER BY sha256(concat_ws('|', 42, doc_id)) LIMIT 50")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by hashed order (a sampling operator: the limit is the feature)."""
    return curate.subsample(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 50)


@query("""
WITH RECURSIVE s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents),
p AS (SELECT source, doc_id, k, 0 AS batch, 1 AS n FROM s WHERE k = 1
  UNION ALL SELECT s.source, s.doc_id, s.k, CASE WHEN s.n_chars * (p.n + 1) > 20000 THEN p.batch + 1 ELSE p.batch END, CASE WHEN s.n_chars * (p.n + 1) > 20000 THEN 1 ELSE p.n + 1 END FROM p JOIN s ON s.source = p.source AND s.k = p.k + 1)
SELECT source, doc_id, batch FROM p
""")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source packed by length into batches of bounded padded size."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("length"))
    return curate.pack_by_length(docs, "length", "doc_id", 20_000, "source").select("source", "doc_id", "batch")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY CUBE (source) ")
def corpus_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and in all (beyond parity)."""
    return table(spark, sf_dir, "documents").cube("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.countDistinct(F.xxhash64("text")).alias("n_texts"))


@query(f"""
WITH d AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS seg, unnest(string_split(text, chr(10))) AS line, lang FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY seg)) AS en_sha, sha256(string_agg(translate(line, 'e', 'E'), chr(10) ORDER BY seg)) AS zh_sha
FROM d WHERE seg % 7 <> 6 GROUP BY doc_id HAVING count(*) >= 3
""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of segments that two configurations share, without bad sources."""
    lines = clean.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id").select(F.col("doc_id").cast("string").alias("document_id"), F.col("lineno").cast("long").alias("segment_id"), F.col("line").alias("source"), F.translate("line", "e", "E").alias("target"), (F.col("lineno") % 7 == 6).alias("is_bad_source"))
    docs = readers.segment_documents(lines, lines)
    return docs.select("document_id", F.col("n").cast("long").alias("n"), F.sha2("en", 256).alias("en_sha"), F.sha2("zh", 256).alias("zh_sha"))


@query("SELECT lang, count(*) AS seen, count(*) FILTER (WHERE length(trim(text)) BETWEEN 10 AND 4000) AS kept, count(DISTINCT CASE WHEN length(trim(text)) BETWEEN 10 AND 4000 THEN trim(text, ' ' || chr(10)) END) AS distinct_prompts FROM documents GROUP BY lang")
def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts with a constant reply: seen, kept and different ones by language."""
    rows = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("prompt"), F.lit("a constant reply").alias("reply"))
    return replay.replay_counts(replay.emit(rows))


@query("SELECT 'en' AS src_lang, 'zhtw' AS tgt_lang, CASE source WHEN 'src0' THEN 'textbook' WHEN 'src1' THEN 'talk' END AS domain, count(*) AS n FROM documents WHERE source IN ('src0', 'src1') GROUP BY source")
def taken_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken of each domain; two sources stand for two corpora."""
    corpus = F.when(F.col("source") == "src0", "coct.en-zhtw.tsv").when(F.col("source") == "src1", "ted2020.en-zhtw.tsv")
    rows = table(spark, sf_dir, "documents").select(F.lit("en").alias("src_lang"), F.lit("zhtw").alias("tgt_lang"), corpus.alias("corpus"))
    return curate.taken_by_domain(rows, readers.corpora(spark))


@query("SELECT count(*) FILTER (WHERE lang = 'en') AS train, count(*) FILTER (WHERE lang <> 'en') AS replay, round(100.0 * avg((lang <> 'en')::INT), 6) AS pct FROM documents")
def replay_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replay records; what is not English stands for them."""
    return curate.replay_share(table(spark, sf_dir, "documents"), F.col("lang") != "en").withColumn("pct", F.round("pct", 6))


