"""From cleaned rows to training records: alignment filter, documents, halves, quotas, dev split, records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siftwright.functions import constants as K
from siftwright.functions import text as T
from siftwright.functions.permute import shuffled_place


def alignment_filter(rows: DataFrame, scores: DataFrame | None, least: float = K.ALIGN_MIN, coverage: float = K.ALIGN_COVERAGE) -> DataFrame:
    """Rows of (corpus, lineno) with a score of `least` or more; a missing score is 0. least=0 passes all rows.

    Missing scores and a coverage under the bound in any corpus are errors.
    """
    if not least:
        return rows
    if scores is None:
        raise FileNotFoundError("alignment scores are required; pass least=0 to go without")
    joined = rows.join(scores.select("corpus", "lineno", F.col("score").alias("_score")), ["corpus", "lineno"], "left")
    short = joined.groupBy("corpus").agg(F.avg(F.col("_score").isNotNull().cast("double")).alias("c")).filter(F.col("c") < coverage)
    found = short.limit(1).collect()
    if found:
        raise ValueError(f"scores cover {found[0]['c']:.4f} of {found[0]['corpus']}, less than {coverage}")
    return joined.filter(F.coalesce("_score", F.lit(0.0)) >= least).drop("_score")


#: Numbers that are ranked together, so that no task sorts a whole group.
BLOCK = 65_536


def ranks(rows: DataFrame, order: Column, bucket: Column, *by: str, name: str = "rn", total: str | None = None) -> DataFrame:
    """rows with their place (from 1) in `order` within `by`, as a row_number over whole groups would give.

    bucket must not fall as order rises. Rows are counted by bucket, the counts summed up over the (few) buckets of a
    group, and rows ranked inside their bucket only: no task sorts a whole group.
    """
    marked = rows.withColumn("_order", order).withColumn("_bucket", bucket)
    counts = marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_m"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_total", F.sum("_m").over(group)).drop("_m")
    for c in (*by, "_bucket"):
        counts = counts.withColumnRenamed(c, f"_c_{c}")
    same = F.col("_bucket").eqNullSafe(F.col("_c__bucket"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    inside = marked.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_order")))
    joined = inside.join(counts, same)
    out = joined.withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_order", "_bucket", "_in", "_before", "_total", *[f"_c_{c}" for c in (*by, "_bucket")])


def hash_ranks(rows: DataFrame, seed: int, key: Column, *by: str, name: str = "rn", total: str | None = None) -> DataFrame:
    """ranks in hashed order; the hash's first digits are the buckets."""
    order = T.hash_order(seed, key)
    return ranks(rows, order, F.substring(order, 1, 3), *by, name=name, total=total)


def islands(rows: DataFrame, *by: str, line: str = "lineno", sides: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Terminated rows with `island`, the same number for rows whose line numbers follow each other."""
    ended = T.terminated(F.col(sides[0]))
    for s in sides[1:]:
        ended = ended & T.terminated(F.col(s))
    placed = ranks(rows.filter(ended), F.col(line), F.floor(F.col(line) / BLOCK), *by, name="_rn")
    return placed.withColumn("island", F.col(line) - F.col("_rn")).drop("_rn")


def build_documents(rows: DataFrame, *by: str, seed: int = K.SEED, least: int = K.DOC_MIN, most: int = K.DOC_MAX, line: str = "lineno", sides: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """(by..., island, part, n_lines, first_line, sides joined by line ends): runs cut into pieces of a hashed length.

    A piece takes `least`..`most` rows by the hash of its group, run and start; a rest under `least` is left out. Each run
    is a partition of a table function that reads its rows in order and holds one piece at a time, however long the run.
    """
    mark = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("island").cast("string"))
    runs = islands(rows, *by, line=line, sides=sides).select(*by, "island", mark.alias("_mark"), F.col(line).cast("long").alias("_line"), *sides)
    typed = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{typed}{', ' if by else ''}island long, part int, n_lines int, first_line long, {', '.join(f'`{s}` string' for s in sides)}"

    class Pieces:
        """The pieces of one run."""

        def __init__(self):
            self.at, self.part, self.take, self.held = 0, 0, 0, []

        def eval(self, row: Row) -> Iterator[tuple]:
            if not self.held:
                drawn = int(hashlib.sha256(f"{row['_mark']}|{self.at}".encode()).hexdigest()[:8], 16)
                self.take = drawn % (most - least + 1) + least
            self.held.append(row)
            if len(self.held) == self.take:
                yield self._piece()

        def terminate(self) -> Iterator[tuple]:
            if len(self.held) >= least:
                yield self._piece()

        def _piece(self) -> tuple:
            first, n = self.held[0], len(self.held)
            out = (*[first[c] for c in by], first["island"], self.part, n, first["_line"], *["\n".join(r[s] for r in self.held) for s in sides])
            self.at, self.part, self.held = self.at + n, self.part + 1, []
            return out

    return udtf(Pieces, returnType=schema)(runs.asTable().partitionBy(*by, "island").orderBy("_line"))


def direction_halves(rows: DataFrame, key: Column, *by: str, seed: int = K.SEED, one_way: dict | None = None) -> DataFrame:
    """Adds src_lang, tgt_lang, src, tgt, rn: the first half by hashed order runs a to b, the second b to a.

    rows has a, b, lang_a, lang_b; corpora in one_way go wholly to their direction.
    """
    marked = hash_ranks(rows, seed, key, *by, name="_rn", total="_n")
    forward = F.col("_rn") <= F.floor(F.col("_n") / 2)
    for corpus, (src, _) in (one_way or {}).items():
        forward = F.when(F.col("corpus") == corpus, F.col("lang_a") == src).otherwise(forward)
    marked = marked.withColumn("_forward", forward)
    pick = lambda x, y: F.when(F.col("_forward"), F.col(x)).otherwise(F.col(y))
    return marked.select(*rows.columns, pick("lang_a", "lang_b").alias("src_lang"), pick("lang_b", "lang_a").alias("tgt_lang"), pick("a", "b").alias("src"), pick("b", "a").alias("tgt"), F.col("_rn").alias("rn"))


def waterfill(quotas: DataFrame, *by: str, ceiling: str = "ceiling", budget: str = "budget", order: str = "ord") -> DataFrame:
    """Adds `take` to rows (by..., ord, ceiling, budget): the smallest ceilings first, what they leave flows on.

    A group is the list of sources of one direction; the fold over it runs in one row.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(ceiling).cast("long").alias("ceiling"), F.col(order).alias("ord"))))
    groups = quotas.groupBy(*by).agg(items.alias("_items"), F.first(F.col(budget).cast("long")).alias("_budget"))
    start = F.struct(F.col("_budget").alias("left"), F.size("_items").alias("n"), F.array().cast("array<struct<ord:int,take:bigint>>").alias("takes"))

    def step(state, x):
        take = F.greatest(F.lit(0).cast("long"), F.least(F.floor(state["left"] / state["n"]), x["ceiling"]))
        return F.struct((state["left"] - take).alias("left"), (state["n"] - 1).alias("n"), F.concat(state["takes"], F.array(F.struct(x["ord"].cast("int").alias("ord"), take.alias("take")))).alias("takes"))

    takes = groups.select(*by, F.explode(F.aggregate("_items", start, step, lambda s: s["takes"])).alias("_t")).select(*by, F.col("_t.ord").alias(order), F.col("_t.take").alias("take"))
    return quotas.join(takes, [*by, order])


def recipe_table(spark, budget: int = K.BUDGET, limit: int | None = None, doc_share: float = K.DOC_SHARE) -> DataFrame:
    """(src_lang, tgt_lang, ord, corpus, cap, sent_budget, doc_budget, hard): the recipes as a table."""
    budget = min(budget, limit) if limit else budget
    doc = int(budget * doc_share)
    rows = [(s, t, i, c, cap, budget - doc, doc, int((budget - doc) * K.MAX_SHARE)) for (s, t), sources in K.RECIPES.items() for i, (c, cap) in enumerate(sources)]
    return spark.createDataFrame(rows, "src_lang string, tgt_lang string, ord int, corpus string, cap long, sent_budget long, doc_budget long, hard long")


def quota_ceilings(recipe: DataFrame, pool_counts: DataFrame) -> DataFrame:
    """recipe with `ceiling`: the least of cap (or the budget), the single-source share and what the pool holds."""
    joined = recipe.join(pool_counts.select("src_lang", "tgt_lang", "corpus", F.col("n").alias("_pool")), ["src_lang", "tgt_lang", "corpus"], "left")
    return joined.withColumn("ceiling", F.least(F.coalesce("cap", "sent_budget"), F.col("hard"), F.coalesce("_pool", F.lit(0)))).drop("_pool")


def take_quota(pool: DataFrame, takes: DataFrame, *keys: str) -> DataFrame:
    """The rows of a pool (with rn within keys) whose rn is within the take of their keys."""
    return pool.join(takes.select(*keys, "take"), list(keys)).filter(F.col("rn") <= F.col("take")).drop("take")


def dev_split(rows: DataFrame, key: Column, *by: str, n: int = K.DEV_PER_DIRECTION, seed: int = K.SEED) -> DataFrame:
    """Adds `part`: dev for the first n rows of each group in hashed order, train for the rest."""
    ranked = hash_ranks(rows, seed, key, *by, name="_rn")
    return ranked.withColumn("part", F.when(F.col("_rn") <= n, "dev").otherwise("train")).drop("_rn")


def placed(rows: DataFrame, key: str, *by: str, seed: int = K.SEED, name: str = "place", total: str = "_n") -> DataFrame:
    """rows with their place (from 0) in a shuffle of their group, and the group's size.

    The place is computed from the row's rank by key (a number without repeats), so the shuffle itself sorts nothing; a
    table that has dense numbers already, as lines have, needs no ranks either: see permute.shuffled_place.
    """
    ranked = ranks(rows, F.col(key), F.floor(F.col(key) / BLOCK), *by, name="_rn", total=total)
    return ranked.withColumn(name, shuffled_place(F.col("_rn") - 1, F.col(total), seed)).drop("_rn")


def halves_by_place(rows: DataFrame, place: str = "place", total: str = "_n") -> DataFrame:
    """Adds `forward`: the first half of each shuffled group runs one way, the rest the other."""
    return rows.withColumn("forward", F.col(place) < F.floor(F.col(total) / 2))


def dev_by_place(rows: DataFrame, n: int = K.DEV_PER_DIRECTION, place: str = "place") -> DataFrame:
    """Adds `part`: dev for the first n places of each shuffled group, train for the rest."""
    return rows.withColumn("part", F.when(F.col(place) < n, "dev").otherwise("train"))


def hold_out(train: DataFrame, frozen: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """train without the pairs of a frozen dev set."""
    return train.join(frozen.select(src, tgt).distinct(), [src, tgt], "left_anti")


def chat_records(rows: DataFrame, key: Column, seed: int = K.SEED) -> DataFrame:
    """Adds `messages`: system, an instruction for the target language (chosen by hash) with the source, and the target."""
    templates = F.lit(None).cast("array<string>")
    for lang, options in K.TEMPLATES.items():
        templates = F.when(F.col("tgt_lang") == lang, F.array(*map(F.lit, options))).otherwise(templates)
    chosen = F.element_at(templates, (F.pmod(T.h32(seed, key), F.size(templates)) + 1).cast("int"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.withColumn("messages", F.array(message("system", F.lit(K.SYSTEM_MESSAGE)), message("user", F.concat(chosen, F.lit("\n"), F.col("src"))), message("assistant", F.col("tgt"))))


def prompt_completion(records: DataFrame, messages: str = "messages") -> DataFrame:
    """(prompt, completion): all messages but the last, and the last."""
    m = F.col(messages)
    return records.withColumn("prompt", F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))).withColumn("completion", F.slice(m, F.greatest(F.size(m), F.lit(1)), F.lit(1))).drop(messages)


def short_falls(got: DataFrame, share: float = 0.98) -> DataFrame:
    """Rows of (..., got, want) that stay under the share of what was wanted."""
    return got.filter(F.col("got") < F.col("want") * share)


def replay_count(train: int, share: float = K.REPLAY_SHARE) -> int:
    """How many replay records make up the share beside so many training records."""
    return int(train * share / max(1 - share, 1e-6))


def subsample(rows: DataFrame, key: Column, n: int, seed: int = K.SEED) -> DataFrame:
    """n rows by hashed order; all of them if there are no more."""
    return rows.orderBy(T.hash_order(seed, key)).limit(n)


def fitting(records: DataFrame, length: Column, most: int = K.MAX_LENGTH) -> DataFrame:
    """Records of at most `most` tokens; longer ones go as a whole and are never cut. The length is the caller's count."""
    return records.filter(length <= most)


def fitting_counts(records: DataFrame, length: Column, *by: str, most: int = K.MAX_LENGTH) -> DataFrame:
    """(by..., n, kept, dropped): what `fitting` keeps."""
    fits = F.coalesce(length <= most, F.lit(False))
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))


def unite(*sources: DataFrame) -> DataFrame:
    """All rows of several sources of one shape, columns by name; a column that a source lacks is null there."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


#: Different lengths of one group that are packed at once; a group with more of them is an error, since a length is a number of tokens.
MOST_LENGTHS = 5_000_000


def pack_by_length(items: DataFrame, length: str = "length", key: str = "id", budget: int = K.TOKEN_BUDGET, *by: str) -> DataFrame:
    """Adds `batch`: items by ascending length (then key) fill batches whose longest times count stays within the budget.

    Items of one length are alike, so only the counts of the different lengths of a group are packed in one task: for
    each length the first batch it enters, the room left there, and how many fill a batch. Every item then finds its
    batch from its rank among those of its length, and these ranks are distributed. Items without a length are left out.
    """
    counts = items.groupBy(*by, length).agg(F.count("*").alias("n"))

    def pack(pdf):
        if len(pdf) > MOST_LENGTHS:
            raise ValueError("more different lengths than token counts can have")
        pdf = pdf.sort_values(length, kind="stable")
        batch, held, first, room, whole = 0, 0, [], [], []
        for size, n in zip(pdf[length].tolist(), pdf["n"].tolist(), strict=True):
            each = max(1, budget // size) if size > 0 else held + n  # of this length in a batch of their own
            fits = min(n, max(0, each - held)) if held else min(n, each)
            first.append(batch), room.append(fits), whole.append(each)
            rest = n - fits
            if rest:
                more = -(-rest // each)
                batch, held = batch + more, rest - (more - 1) * each
            else:
                held += fits
        return pdf.assign(_first=first, _room=room, _each=whole)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema) + ", _first long, _room long, _each long"
    placed = counts.groupBy(*by).applyInPandas(pack, schema)
    numeric = items.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "decimal", "float", "double")
    bucket = F.floor(F.col(key) / BLOCK) if numeric else F.substring(F.col(key).cast("string"), 1, 3)
    ranked = ranks(items.filter(F.col(length).isNotNull()), F.col(key), bucket, *by, length, name="_rank").withColumn("_rank", F.col("_rank") - 1)
    for c in (*by, length):
        placed = placed.withColumnRenamed(c, f"_p_{c}")
    same = F.lit(True)
    for c in (*by, length):
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    joined = ranked.join(placed.drop("n"), same)
    batch = F.when(F.col("_rank") < F.col("_room"), F.col("_first")).otherwise(F.col("_first") + 1 + F.floor((F.col("_rank") - F.col("_room")) / F.col("_each")))
    return joined.withColumn("batch", batch.cast("int")).select(*items.columns, "batch")


def taken_by_domain(taken: DataFrame, registry: DataFrame) -> DataFrame:
    """(src_lang, tgt_lang, domain, n): rows taken of each domain."""
    return taken.join(registry.select("corpus", "domain"), "corpus").groupBy("src_lang", "tgt_lang", "domain").agg(F.count("*").alias("n"))


def replay_share(records: DataFrame, is_replay: Column) -> DataFrame:
    """One row (train, replay, pct): the share of replay records."""
    return records.agg(F.count_if(~is_replay).alias("train"), F.count_if(is_replay).alias("replay"), (F.avg(is_replay.cast("double")) * 100).alias("pct"))
