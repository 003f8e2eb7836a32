"""The operators applied to the whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, audit, chat, decontaminate, licences, media, mixing, near, pii, recompress, repeats, tokens, toxicity

TOXIC_FROM = 0.7


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark")))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return media.read_media(stored)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.train(docs), keep=["doc_id"])
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_paragraphs"), F.array_join(families, ",").alias("families"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.read_chats(chat.format_chats(rows.unionByName(probe))))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, may_learn=fold_of() != 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, _read(spark, sf_dir, "labels")), threshold=TOXIC_FROM, keep=["doc_id"])
    return scored.select("doc_id", (fold_of() == 1).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), *paths, keep=["doc_id"])


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = recompress.remove_repeated_windows(_read(spark, sf_dir, "documents").select("doc_id", "text"), 13, keep=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_mix, op3_pii, op4_tokens, op5_media, op6_licences, op7_chat, op8_near_duplicates, op9_repeats, op10_toxicity, op11_alignment, op12_substrings, op13_filter_audit)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(column: str) -> str:
    return _WORDS.format(_LOWER.format(f"coalesce({column}, '')"))


#: The hits of op1 for a relation of documents (row, doc_id, w: its words).
HITS_SQL = f"""
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item FROM places p JOIN windows USING (gram)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
"""

OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents), {HITS_SQL}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

#: Steps of op2 over a relation mixed(doc_id, text, source, ...): the share's level by the order in which sources fill up, then a
#: running sum in hash order up to what whole copies leave.
MIX_SQL = r"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM mixed),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM totals),
filling AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(most) OVER before, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM ranked WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(CAST(total - held AS DOUBLE) / CAST(open_weight AS DOUBLE), most / weight) AS value FROM filling
  WHERE CAST(total - held AS DOUBLE) / CAST(open_weight AS DOUBLE) <= most / weight),
targets AS (SELECT source, source_size, least(CAST(most AS DOUBLE), CAST(weight AS DOUBLE) * value) AS target FROM ranked, level),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
chosen AS (
  SELECT r.source, r.h, source_size, target, whole,
    CASE WHEN b.target - whole * source_size <= 0 THEN 0 WHEN upto <= b.target - whole * source_size THEN 1
      WHEN upto - words <= b.target - whole * source_size AND upto - (b.target - whole * source_size) < (b.target - whole * source_size) - (upto - words) THEN 1 ELSE 0 END AS extra
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
"""

OP2_SQL = f"""
WITH mixed AS (SELECT doc_id, text, source FROM documents), {MIX_SQL}
SELECT doc_id, size, source_size, target, CAST(size * least(whole + extra, 3) AS BIGINT) AS taken
FROM sized s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h
"""

#: Control strings of op7 with what was put after their first character, and a turn's escaped form.
_CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
OP7_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
ordered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows),
sized AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))
    + CASE WHEN before IS NULL OR before <> role THEN 32 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) ELSE 8 END AS chars FROM ordered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_WORDS12 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS12} AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13),
windows AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM places),
firsts AS (SELECT gram, min(doc_id) AS first FROM windows GROUP BY gram HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM windows JOIN firsts USING (gram) WHERE doc_id > first) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (r)
"""

#: op13: documents by what they fail, then each order over those counts.
OP13_SQL = f"""
WITH docs AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, {_WORDS12} AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN docs.doc_id > min(docs.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM docs LEFT JOIN known USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
met AS (
  SELECT k.*, o, coalesce(list_min(list_transform(CASE WHEN fails = '' THEN NULL ELSE string_split(fails, '') END, lambda l: strpos(o, l))), 6) AS gone
  FROM kinds k, orders),
steps AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, o[s] AS filter,
    sum(CASE WHEN gone > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < s AND contains(fails, o[s]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = o[s] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = s THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s THEN toxic ELSE 0 END) AS toxic_lost
  FROM met, (SELECT unnest(range(1, 6)) AS s) GROUP BY part, o, s)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM steps
"""

ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op2_mix": OP2_SQL, "op7_chat": OP7_SQL, "op12_substrings": OP12_SQL, "op13_filter_audit": OP13_SQL}
