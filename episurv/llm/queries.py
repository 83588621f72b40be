"""The operators as queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.llm import alignment, chat, exact, html, language, licenses, lines, packing, shards, simhash, substrings, variants
from episurv.llm.common import stored, table
from episurv.llm.decontaminate import contamination_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL text that must give the same rows."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(rf"""
WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS p FROM (
    SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p
    FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases)),
found AS (
  SELECT DISTINCT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places)
  JOIN phrases USING (n, p)),
hits AS (SELECT doc_id, count(DISTINCT j) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS k, sha256(string_agg(name, ',' ORDER BY name)) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(k, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(r"""
WITH blocks AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>((?s).*?)</article>', 1), '') AS a FROM pages),
parts AS (
  SELECT page_id, url, list_transform(string_split_regex(regexp_replace(a, '</?b>', '', 'g'), '</?(p|h1|br)>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS p
  FROM blocks),
texts AS (SELECT page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), ' ') AS text FROM parts)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
""")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query(r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN repeated USING (s))
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs)
  ANTI JOIN (SELECT doc_id, unnest(js) AS j FROM gone) USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_CHAT_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|SEP\])', '\1\\\2\3', 'g')"


@query(rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
pieces AS (
  SELECT *, length({_CHAT_ESCAPE.format('text')}) + CASE WHEN before = role THEN 5
    ELSE 9 + 7 + 4 + length({_CHAT_ESCAPE.format('role')}) END AS size FROM numbered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id
""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.inline(F.array(*[
            F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
            for n, role in enumerate(("user", "assistant"))
        ])),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(turns.unionByName(more))
    again = formatted.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_trained(F.col("formatted"), F.col("loss_mask")).alias("trained"),
    )
    lines_of = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return again.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines_of, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _alike(x: str, y: str) -> str:
    """SQL for how many of the three neighbours on one side are the same."""
    first, second, third = (f"{x}[{k}] = {y}[{k}]" for k in (1, 2, 3))
    return f"CASE WHEN {first} THEN CASE WHEN {second} THEN CASE WHEN {third} THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END"


@query(rf"""
WITH cut AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
whole AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM cut),
solid AS (
  SELECT doc_id, n, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i
  FROM (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM whole) WHERE s <> ''),
near AS (
  SELECT *, [lead(s, 1) OVER v, lead(s, 2) OVER v, lead(s, 3) OVER v] AS after, [lag(s, 1) OVER v, lag(s, 2) OVER v, lag(s, 3) OVER v] AS before,
    CASE WHEN w >= 50 THEN 1 WHEN w + lead(w, 1) OVER v >= 50 THEN 2 WHEN w + lead(w, 1) OVER v + lead(w, 2) OVER v >= 50 THEN 3
      WHEN lead(s, 3) OVER v IS NOT NULL THEN 4 END AS size
  FROM solid WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, size, array_to_string(list_concat([s], after)[1:size], chr(10)) AS r FROM near WHERE size IS NOT NULL),
placed AS (SELECT doc_id, i, size, first_value(doc_id) OVER v AS other, first_value(i) OVER v AS k FROM runs WINDOW v AS (PARTITION BY r ORDER BY doc_id, i)),
later AS (SELECT * FROM placed WHERE doc_id <> other OR i <> k),
spans AS (
  SELECT later.doc_id, later.i - {_alike('a.before', 'b.before')} AS lo, later.i + later.size + {_alike('c.after', 'd.after')} AS hi FROM later
  JOIN near a ON a.doc_id = later.doc_id AND a.i = later.i
  JOIN near b ON b.doc_id = later.other AND b.i = later.k
  JOIN near c ON c.doc_id = later.doc_id AND c.i = later.i + later.size - 1
  JOIN near d ON d.doc_id = later.other AND d.i = later.k + later.size - 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi)) AS i FROM spans),
marked AS (SELECT w.doc_id, w.n, w.line, s.i IS NOT NULL AS solid, g.i IS NOT NULL AS drop
  FROM whole w LEFT JOIN solid s USING (doc_id, n) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = s.i)
SELECT doc_id, (count(*) FILTER (solid))::BIGINT AS n_lines, (count(*) FILTER (drop))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "_row.doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256"),
    )


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    learnt = language.prototypes(docs.filter("NOT held_out"), "doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", "held_out")
    return language.identify(rows, learnt).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
FROM docs WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    n_groups = F.size("links").cast("long")
    rows = stored(
        found.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            "n_a",
            "n_b",
            n_groups.alias("n_groups"),
            F.when(n_groups == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
            "links",
        ),
        "aligned",
    )
    scores = alignment.link_scores(rows, "_row")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(scores, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", *counts, "groups_sha256")


#: One run of letters of so many loses a letter before variants are grouped.
LOSES_A_LETTER = 31


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs_of_letters(table(spark, sf_dir, "documents"), "text", "doc_id")
    # Only those that are long enough afterwards matter; others are not hashed.
    runs = runs.filter(F.length("run") >= variants.LEAST_LENGTH)
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.crc32(F.concat(owner, F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod("_hash", F.length("run"))
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select("run", h.alias("_hash")).select(
        F.when(F.col("_hash") % LOSES_A_LETTER == 0, less).otherwise(F.col("run")).alias("word")
    )
    return variants.group_variants(variants.counted_words(words)).select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] == "base")
    first = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
