"""How far the sources of each language differ in their terms: counts and partial sums by shard in DuckDB, sums and ranks in Spark.

Pass one: every task counts terms of its documents with DuckDB (blocks of `BLOCK_CHARS` characters, at most `HELD_ROWS`
counts held), the counts are hashed to shards by (lang, term), and each shard adds them up and keeps the terms that are
in at least `MIN_DOCS` documents of the lang. Pass two: the kept counts meet their group's totals and go to shards by
(lang, term) again; each shard gives, per pair of sources, the partial sum over terms that both have, per source how many
terms it has how often, and per source its best terms.

A shard only looks at groups that have a term, so the terms that one source lacks are put in afterwards. With p the share of a
term, z the share that a count of 0 gives, f(p, q) = floor((p - q)^2 / (p + q)), and T the terms that a source has, the sum over
all V kept terms of a pair (g, h) is
    sum over both of f(pg, ph) - f(pg, zh) - f(zg, ph) + f(zg, zh)      from the shards
  + sum over Tg of f(pg, zh) + sum over Th of f(zg, ph)                  from how many terms have which count
  + (V - |Tg| - |Th|) f(zg, zh).                                         from the totals
All of it is integer arithmetic. No row of a group is made for a term it lacks, whatever the number of sources.

Defined results: null text, lang or source counts as ''; a document is a row, so repeated rows count each; a lang without
kept terms has its `pair` rows with value 0 and no `term` row; a lang with one source has no `pair` row; ties are ranked by
the item's UTF-8 bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import checkpointed, table, written

#: Runs of ASCII letters and of anything beyond ASCII.
TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Characters that DuckDB splits at once, and counts that a task holds before they go on or are added up.
BLOCK_CHARS = 4_000_000
HELD_ROWS = 1_000_000
#: Tasks that the count table of one lang is dealt to.
SALTS = 32

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, leads int"
SUMS = "kind string, lang string, source string, item string, amount long, value long"

LOWERED = "CASE WHEN strlen(text) = length(text) THEN lower(text) ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
COUNT_BLOCK = f"""
INSERT INTO held
SELECT lang, source, term, sum(c)::BIGINT, count(*)::BIGINT
FROM (SELECT lang, source, doc, term, count(*) AS c
      FROM (SELECT lang, source, doc, unnest(regexp_extract_all({LOWERED}, '{TERMS}')) AS term FROM block)
      GROUP BY ALL)
GROUP BY ALL"""
ADD_UP = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
KEEP = f"""
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS leads
FROM ({ADD_UP})
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {MIN_DOCS}"""


def _share(count: str, total: str = "total") -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({count} + 2)) // ({total} + 2 * v))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) // (({p}) + ({q}))"


SHARES = f"""
CREATE TABLE shares AS
SELECT lang, source, dense_rank() OVER (ORDER BY lang, term) AS t, term, {_share('n')} AS p, {_share('0')} AS z, n,
       {_share('sum(n) OVER (PARTITION BY lang, term)', 'lang_total')} AS q
FROM held"""
PAIR_SUMS = f"""
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, NULL::BIGINT AS amount,
       sum({_f('a.p', 'b.p')} - {_f('a.p', 'b.z')} - {_f('a.z', 'b.p')} + {_f('a.z', 'b.z')})::BIGINT AS value
FROM shares a JOIN shares b ON a.t = b.t AND a.source < b.source
GROUP BY ALL"""
COUNT_SUMS = "SELECT 'count' AS kind, lang, source, NULL::VARCHAR AS item, n AS amount, count(*)::BIGINT AS value FROM shares GROUP BY ALL"
BEST_TERMS = f"""
SELECT 'term' AS kind, lang, source, term AS item, NULL::BIGINT AS amount, {_f('p', 'q')} AS value FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP_TERMS}"""


def _connect(columns: str) -> duckdb.DuckDBPyConnection:
    """An in-memory database of one thread: Spark runs one a task."""
    con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False})
    con.execute(f"CREATE TABLE held ({columns})")
    return con


def _rows(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in con.sql(sql).to_arrow_reader(100_000):
        yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start, chars = 0, 0
    for i, n in enumerate(batch.column("chars").to_pylist()):
        chars += n
        if chars >= BLOCK_CHARS or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, chars = i + 1, 0


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n occurrences, docs) of each task, not yet added up over tasks."""
    schema = _arrow(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT")
        for batch in batches:
            for part in _blocks(batch):
                block = pa.table([*part.columns[:3], pa.array(range(part.num_rows), pa.int64())], names=["text", "lang", "source", "doc"])
                con.register("block", block)
                con.execute(COUNT_BLOCK)
                con.unregister("block")
                if con.execute("SELECT count(*) FROM held").fetchall()[0][0] > HELD_ROWS:
                    yield from _rows(con, ADD_UP, schema)
                    con.execute("TRUNCATE held")
        yield from _rows(con, ADD_UP, schema)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*named).withColumn("chars", F.char_length("text")).mapInArrow(run, COUNTS)


def kept_counts(docs: DataFrame) -> DataFrame:
    """One row per lang, source and kept term that the source has: n, and leads = 1 on one row of each lang and term."""
    schema = _arrow(KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held = _connect("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT"), 0
        for batch in batches:
            con.register("block", pa.table(batch))
            con.execute("INSERT INTO held SELECT * FROM block")
            con.unregister("block")
            held += batch.num_rows
            if held > HELD_ROWS:
                con.execute(f"CREATE TABLE sums AS {ADD_UP}; DROP TABLE held; ALTER TABLE sums RENAME TO held")
                held = 0
        yield from _rows(con, KEEP, schema)

    return term_counts(docs).repartition("lang", "term").mapInArrow(run, KEPT)


def partial_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Per shard: sums of pairs over terms that both sources have, how many terms a source has how often, its best terms."""
    schema = _arrow(SUMS)
    columns = ["lang", "source", "term", "n", "total", "lang_total", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, lang_total BIGINT, v BIGINT")
        for batch in batches:
            con.register("block", pa.table(batch))
            con.execute("INSERT INTO held SELECT * FROM block")
            con.unregister("block")
        con.execute(SHARES)
        for sql in (PAIR_SUMS, COUNT_SUMS, BEST_TERMS):
            yield from _rows(con, sql, schema)

    return kept.join(groups, ["lang", "source"]).select(*columns).repartition("lang", "term").mapInArrow(run, SUMS)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs: total and terms of its kept terms, lang_total and v (kept terms) of its lang."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"), F.sum("leads").alias("leads"))
    lang = Window.partitionBy("lang")
    filled = named.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "terms", "leads"])
    return filled.select("lang", "source", "total", "terms", F.sum("total").over(lang).alias("lang_total"), F.sum("leads").over(lang).alias("v"))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 v)); null for v = 0, where there is no term."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = F.nullif((total + 2 * v).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return (F.call_function("div", above, below) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = written(kept_counts(docs), "divergence-kept")
    groups = checkpointed(group_totals(docs, kept))
    sums = written(partial_sums(kept, groups), "divergence-sums")

    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    ours = groups.select("lang", "source", "total", "v", "terms", zero.alias("z"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("their_terms"), zero.alias("their_z"))
    pairs = ours.join(theirs, "lang").filter("source <> item")
    none = pairs.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("their_terms")) * gap(F.col("z"), F.col("their_z")), F.lit(0)).alias("value"))
    both = sums.filter("kind = 'pair'").select("lang", "source", "item", "value")

    salt = F.pmod(F.xxhash64("source", "amount"), F.lit(SALTS)).cast("int")
    counts = sums.filter("kind = 'count'").groupBy("lang", "source", "amount").agg(F.sum("value").alias("terms_of"))
    counts = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
    counts = counts.select("lang", "source", "terms_of", share(F.col("amount"), F.col("total"), F.col("v")).alias("p"), salt.alias("salt"))
    others = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = counts.join(others, ["lang", "salt"]).filter("source <> item").select("lang", "source", "item", (F.col("terms_of") * gap(F.col("p"), F.col("their_z"))).alias("value"))

    sided = both.unionByName(one)
    turned = sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pair = none.unionByName(sided).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    term = sums.filter("kind = 'term'").select("lang", "source", "item", "value").withColumn("part", F.lit("term"))

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pair).unionByName(ranked(term).filter(F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_GAP = "((g.p - h.p) * (g.p - h.p)) // (g.p + h.p)"
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}') AS terms
  FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
         (1 + ({UNIT} * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p
  FROM full_counts),
pooled AS (
  SELECT lang, term, (1 + ({UNIT} * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)))::BIGINT AS p
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM full_counts GROUP BY ALL)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT g.lang, g.source, h.source AS item, sum({_GAP}) AS value
             FROM shares g JOIN shares h ON g.lang = h.lang AND g.term = h.term AND g.source <> h.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT g.lang, g.source, g.term AS item, {_GAP} AS value
  FROM shares g JOIN pooled h ON g.lang = h.lang AND g.term = h.term WHERE g.n > 0 AND g.p > h.p)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS}
"""
