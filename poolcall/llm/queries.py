"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolcall.llm.common import table, word_count
from poolcall.llm.infilling import fill_in_middle
from poolcall.llm.language import identify_held_out
from poolcall.llm.line_quality import line_quality
from poolcall.llm.mixing import mix
from poolcall.llm.neighbours import nearest
from poolcall.llm.packing import pack_documents
from poolcall.llm.ranking import rank_documents
from poolcall.llm.set_join import jaccard_components
from poolcall.llm.simhash import near_duplicates
from poolcall.llm.substrings import dedup_substrings
from poolcall.llm.tokens import count_tokens, read_vocabulary
from poolcall.llm.tool_calls import link_tool_calls
from poolcall.llm.weak_quality import weak_quality


def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())


TOOLS = [("answer", "question", "string", True), ("answer", "turn", "integer", True), ("answer", "after", "string", False),
         ("search", "question", "string", True), ("search", "turn", "integer", True)]


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls, so each user turn is taken as one and the assistant's next turn as its result.

    Long questions call ``search``, others ``answer``. A call depends on the conversation's call two turns before; in each
    third conversation on the one two turns later, so the order of turns must be turned round. ``search`` knows no
    ``after``, so calls of that kind that name one are invalid."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    asked = turns.filter("role = 'user'").withColumn("step", F.when(F.col("conv_id") % 3 == 0, F.lit(2)).otherwise(F.lit(-2)))
    named = asked.select("conv_id", "turn", "text", call_id(F.col("turn")).alias("call_id"), call_id(F.col("turn") + F.col("step")).alias("on"),
                         F.when(F.length("text") > 200, "search").otherwise("answer").alias("name"))
    ids = named.select("conv_id", F.col("call_id").alias("on")).distinct()
    depends = named.select("conv_id", "call_id", "on").join(ids, ["conv_id", "on"], "left_semi")
    after = F.when(F.col("conv_id") % 7 == 1, F.col("on"))
    calls = named.select("conv_id", "turn", "call_id", "name", F.to_json(F.struct(F.col("turn"), F.col("text").alias("question"), after.alias("after"))).alias("arguments"))
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return link_tool_calls(calls, results, spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean"), depends)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("n_tokens")))


def source_tree() -> dict:
    """Domain, language and source of a document; the tables name no domains, so sources are grouped by their last digit."""
    return {"domain": F.concat(F.lit("d"), F.substring("source", -1, 1)), "language": F.col("lang"), "leaf": F.col("source")}


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), source_tree(), share=MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 7


def _level(path: list[str], parent: str) -> str:
    """DuckDB form of one level of the budget tree."""
    keys, up, name = ", ".join(path), ", ".join(path[:-1]), f"n{len(path)}"
    part = f"PARTITION BY {up}" if up else ""
    join = f"JOIN {parent} USING ({up})" if up else f"CROSS JOIN {parent}"
    order = f"cap / weight, {path[-1]}"
    return f"""
{name}a AS (SELECT {keys}, sum(supply) * {MIX_EPOCHS} AS cap, greatest(floor(sqrt(CAST(sum(supply) AS DOUBLE))), 1)::DOUBLE AS weight FROM leaves GROUP BY {keys}),
{name}b AS (SELECT {keys}, cap, weight, alloc,
  (alloc - coalesce(sum(cap) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM {name}a {join}),
{name}c AS (SELECT *, first_value(CASE WHEN cap > lvl * weight THEN lvl END IGNORE NULLS) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mark FROM {name}b),
{name} AS (SELECT {keys}, CASE WHEN mark IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, mark * weight) END AS alloc FROM {name}c)"""


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce('d' || right(source, 1), '(none)') AS domain, coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS leaf,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, leaf, sum(n_tokens)::BIGINT AS supply FROM t GROUP BY ALL),
n0 AS (SELECT least(floor(sum(supply) * CAST({MIX_SHARE} AS DOUBLE)), sum(supply) * {MIX_EPOCHS})::DOUBLE AS alloc FROM leaves),
{_level(["domain"], "n0")}, {_level(["domain", "language"], "n1")}, {_level(["domain", "language", "leaf"], "n2")},
plan AS (SELECT domain, language, leaf, supply, floor(alloc)::BIGINT AS target FROM leaves JOIN n3 USING (domain, language, leaf)),
p2 AS (SELECT *, CASE WHEN supply > 0 THEN target // supply ELSE 0 END AS full_epochs FROM plan),
drawn AS (SELECT t.*, p2.target, p2.full_epochs, p2.target - p2.full_epochs * p2.supply AS rest,
  md5('{MIX_SEED}:' || p2.full_epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM t JOIN p2 USING (domain, language, leaf)),
ran AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, leaf ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM drawn)
SELECT doc_id, domain, language, leaf, n_tokens,
  (CASE WHEN n_tokens > 0 THEN full_epochs ELSE 0 END + CASE WHEN n_tokens > 0 AND before < rest THEN 1 ELSE 0 END)::BIGINT AS copies, target FROM ran
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
it AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM it GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM dt),
occ AS (SELECT r, unnest(terms) AS term FROM dt),
tf AS (SELECT r, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * coalesce(df, 0) + 1))) AS BIGINT) AS w
  FROM (SELECT DISTINCT term FROM asked) LEFT JOIN df USING (term), total),
m AS (SELECT doc_id, r, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM dt, total WHERE doc_id IS NOT NULL),
s AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id::BIGINT AS item_id, rank::INTEGER AS rank, doc_id::BIGINT AS doc_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
sets AS (SELECT DISTINCT doc_id, shingle FROM s),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS start, doc_id AS node FROM w UNION SELECT start, b FROM reach JOIN links ON a = node)
SELECT w.doc_id::BIGINT AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(node)::BIGINT AS component_id
FROM w JOIN reach ON start = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:x], '') AS prefix, CASE WHEN y > x THEN array_to_string(u[x + 1:y], '') ELSE '' END AS middle, array_to_string(u[y + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_weak_quality, op2_language, op3_line_quality, op4_token_counts, op5_tool_calls, op6_simhash, op7_substrings, op8_packing, op9_neighbours, op10_mixing,
    op11_ranking, op12_set_join, op13_infilling)}
ORACLES: dict[str, str] = {"op10_mixing": OP10_SQL, "op11_ranking": OP11_SQL, "op12_set_join": OP12_SQL, "op13_infilling": OP13_SQL}
