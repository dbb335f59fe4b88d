"""Queries of scans, fields, filters and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import predicates as P
from ..functions import text as X
from ..operators import corpus as C
from ..spec import scaled_budget, val_target
from . import sql as S
from .registry import query, table


@query("SELECT doc_id, lang FROM documents WHERE replace(lower(trim(lang)), '_', '-') IN ('en', 'eng', 'english') OR replace(lower(trim(lang)), '_', '-') LIKE 'en-%'")
def filter_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language")
    return d.where(P.conditions(d, {"language": "en"})).select("doc_id", F.col("language").alias("lang"))


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND NOT quality < 1")
def filter_special_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").withColumnRenamed("quality", "edu_int_score")
    return d.where(P.conditions(d, {"edu_int_score_min": 1})).select("doc_id", F.col("edu_int_score").alias("quality"))


@query("SELECT event_id, value FROM events WHERE value >= 10 AND NOT isnan(value) AND value < 50")
def filter_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return d.where(P.conditions(d, {"value_min": 10, "value_max": 50})).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE event_type IN ('click', 'purchase'))")
def filter_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return d.where(P.conditions(d, {"event_type_in": ["click", "purchase"]})).select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 4000 AND source IN ('src0', 'src1', 'src2', 'src3')")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language")
    wanted = {"language": "english", "n_chars_min": 500, "n_chars_max": 4000, "source_in": ["src0", "src1", "src2", "src3"], "ignored": 1}
    return d.where(P.conditions(d, wanted)).select("doc_id")


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) >= 3 AND CAST(props ->> '$.k' AS DOUBLE) < 8")
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumnRenamed("props", "meta")
    return d.where(P.conditions(d, {"k_min": 3, "k_max": 8})).select("event_id", P.field(d, "k").cast("long").alias("k"))


@query(f"SELECT page_id, nullif({S.strip('html')}, '') AS text FROM pages")
def text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.nonblank(F.col("html")).alias("text"))


@query(
    f"""WITH q AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS response FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')
SELECT conv_id, turn, CASE WHEN nullif({S.strip("question")}, '') IS NOT NULL AND nullif({S.strip("response")}, '') IS NOT NULL
  THEN {S.strip("'Question: ' || " + S.strip("question") + " || chr(10) || 'Answer: ' || " + S.strip("response"))} END AS text FROM q"""
)
def template_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the answer that follows it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    q = asked.join(answers, ["conv_id", "turn"], "left")
    return q.select("conv_id", "turn", X.render("Question: {question}\nAnswer: {response}", {"question": q["question"], "response": q["response"]}).alias("text"))


@query("SELECT DISTINCT source, lower(regexp_replace(regexp_replace('Set ' || source || ' / é', '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def source_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", X.slug(F.concat(F.lit("Set "), "source", F.lit(" / é"))).alias("slug"))


@query(
    """SELECT source, CAST(greatest(2, round_even(sum(n_chars) * 0.125, 0)) AS BIGINT) AS budget, CAST(round_even(sum(n_chars) * 0.005, 0) AS BIGINT) AS val_budget FROM documents GROUP BY source"""
)
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled budgets of every source, by the library's own rounding."""
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).collect()  # a row for each source
    return spark.createDataFrame([(r.source, scaled_budget(r.n, 0.125), val_target(r.n, 0.005)) for r in sums], "source string, budget long, val_budget long")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.digest(F.col("text")).alias("sha256"))


@query(f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {S.words(S.clean('text'))} AS w FROM documents)")
def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.normalized_words(X.clean(F.col("text"))).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@query(
    f"""WITH w AS (SELECT doc_id, {S.words("text")} AS w FROM documents), s AS (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w))
SELECT doc_id, count(*) AS shingles, count(DISTINCT s) AS different FROM s GROUP BY doc_id"""
)
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.word_shingles(X.normalized_words(F.col("text")), 8).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("long").alias("shingles"), F.size(F.array_distinct("s")).cast("long").alias("different"))


@query(f"SELECT doc_id, i AS segment, substr(t, i * 1000 + 1, 1000) AS text FROM (SELECT doc_id, t, unnest(range(0, (greatest(length(t), 1) - 1) // 1000 + 1)) AS i FROM (SELECT doc_id, {S.clean('text')} AS t FROM documents))")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("t"))
    return d.select("doc_id", F.posexplode(X.segments(F.col("t"), 1000)).alias("segment", "text")).select("doc_id", F.col("segment").cast("long").alias("segment"), "text")


_WIKI = "replace(text, 's ''', 's''')"
_WIKI = f"regexp_replace({_WIKI}, '/'' [0-9]/', '/''[0-9]/', 'g')"
for _a, _b in ((" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", ")):
    _WIKI = f"replace({_WIKI}, '{_a}', '{_b}')"
for _a, _b, _c in (("\\(", "^\\)", "\\)"), ("\\[", "^\\]", "\\]"), ("\\{", "^}", "\\}"), ('"', '^"', '"'), ("''", "^''", "''")):
    _o, _e = _a.replace("\\", ""), _c.replace("\\", "")
    _WIKI = f"regexp_replace({_WIKI}, '{_a}{S.SPACE}*([{_b}]*?){S.SPACE}*{_c}', '{_o}\\1{_e}', 'g')"
for _a, _b in (("'= = = ='", "'===='"), ("'= = ='", "'==='"), ("'= ='", "'=='"), ("' ° '", "'°'"), ("' ' || chr(10)", "chr(10)"), ("chr(10) || ' '", "chr(10)"), ("' N '", "' 1 '"), ("' ''s'", "'''s'")):
    _WIKI = f"replace({_WIKI}, {_a}, {_b})"


@query(f"SELECT doc_id, {_WIKI} AS text FROM documents")
def wiki_detokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.wiki_detokenize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len(string_split_regex(text, '{S.SPACE}+')) AS words, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def word_and_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.spaced_parts(F.col("text")).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"))


_PIECES = f"SELECT unnest(string_split_regex(text, '{S.SPACE}+')) AS w FROM documents"


@query(
    rf"""WITH p AS ({_PIECES})
SELECT count(*) FILTER (regexp_matches(w, '^[ \t]*[A-Za-z0-9+/]{{16,}}={{0,2}}$') AND regexp_matches(w, '[0-9]')) AS base64_like, count(*) FILTER (regexp_matches(w, '^[ \t]*[0-9A-Fa-f]{{16,}}$')) AS hex_like,
  count(*) FILTER (regexp_matches(w, '^[ \t]*[A-Za-z][A-Za-z-]{{3,}}$')) AS word_like, count(*) FILTER (regexp_matches(w, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2FA1F}}]')) AS han,
  count(*) FILTER (regexp_matches(w, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS control, count(*) FILTER (strlen(w) > 32) AS overlong FROM p"""
)
def pattern_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    p = table(spark, sf_dir, "documents").select(F.explode(F.split("text", f"{X.SPACE}+", -1)).alias("w"))
    each = {"base64_like": X.looks_base64(w), "hex_like": X.looks_hex(w), "word_like": X.looks_word(w), "han": X.has_han(w), "control": X.has_control(w), "overlong": F.octet_length(w) > 32}
    return p.agg(*(F.count_if(c).alias(k) for k, c in each.items()))


@query("SELECT doc_id, string_split(string_split(text, '.')[1], ',')[1] AS text FROM documents")
def stop_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.until_stops(F.col("text"), [".", ","]).alias("text"))


@query(
    f"""WITH c AS (SELECT {S.clean("text")} AS t FROM documents), k AS (SELECT length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS l FROM c)
SELECT CASE WHEN a >= 0.7 * greatest(l, 1) THEN 'en_like' ELSE 'other_or_mixed' END AS kind, count(*) AS documents FROM k GROUP BY 1"""
)
def language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(X.clean(F.col("text")).alias("t"))
    return d.groupBy(F.when(X.mostly_ascii_letters(F.col("t")), "en_like").otherwise("other_or_mixed").alias("kind")).agg(F.count("*").alias("documents"))


@query(f"SELECT text, count(*) AS n FROM (SELECT substr(t, i * 500 + 1, 500) AS text FROM (SELECT t, unnest(range(0, (length(t) - 1) // 500 + 1)) AS i FROM (SELECT {S.clean('text')} AS t FROM documents) WHERE t <> '')) GROUP BY text")
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as lines of at most 500 characters, written as text files and read back."""
    folder = storage.work_dir(spark, "lines")
    written = X.lines_of(table(spark, sf_dir, "documents"), 500)
    written.write.text(folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("text")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(100).select("doc_id", "text")


@query("SELECT source, doc_id FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("source", "doc_id")
    return d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 5").drop("n")


@query("SELECT quality, toxic, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def labelled_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def mixture_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
