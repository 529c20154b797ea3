"""The operators applied to the standard tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import decontaminate, hosts, interactions, language, mixing, pieces, preference, quality, rules, sharding, simhash, spelling, tokens

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir.rstrip("/"))

        QUERIES[name] = configured
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


N_SHARDS = 16


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES = [
    hosts.Rule("allow", "org", "/"), hosts.Rule("block", "example.org", "/es/"), hosts.Rule("block", "example.org", "/en/1"),
    hosts.Rule("allow", "com", "/fr/"), hosts.Rule("block", "com", "/de/"),
]
MAX_BAD = 0.25
#: Pages show a document each; its id is the number in the second part of the path.
PAGE_DOCUMENT = r"^/[^/]*/([0-9]{1,18})"


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): 1 where the document shown is labelled of low quality; pages without a label are left out."""
    _, path = hosts.url_parts(F.col("url"))
    shown = pages.select("page_id", F.regexp_extract(path, PAGE_DOCUMENT, 1).try_cast("long").alias("doc_id"))
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max(1 - F.col("quality")).cast("long").alias("bad"))
    return shown.join(marks, "doc_id").select("page_id", "bad")


OP10_SQL = """WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
marks AS (SELECT doc_id, max(1 - quality)::BIGINT AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcome AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, try_cast(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT) AS doc_id FROM split) JOIN marks USING (doc_id) GROUP BY page_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site,
  string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM split LEFT JOIN outcome USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN regexp_matches(site, '^([0-9.]+|\\[.*)$') THEN site WHEN array_to_string(labels[-2:], '.') IN TWO_LABEL_SUFFIXES THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix,
  CASE WHEN regexp_matches(site, '^([0-9.]+|\\[.*)$') THEN site WHEN array_to_string(labels[-2:], '.') IN TWO_LABEL_SUFFIXES THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
sums AS (SELECT 'host' AS level, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, count(*) FILTER (n > 0) AS k, sum(n * n)::DOUBLE AS n2, coalesce(sum(bad * bad / nullif(n, 0)::DOUBLE), 0) AS x2 FROM hosts
  UNION ALL SELECT 'domain', coalesce(sum(n), 0)::DOUBLE, coalesce(sum(bad), 0)::DOUBLE, count(*) FILTER (n > 0), sum(n * n)::DOUBLE, coalesce(sum(bad * bad / nullif(n, 0)::DOUBLE), 0) FROM domains
  UNION ALL SELECT 'suffix', coalesce(sum(n), 0)::DOUBLE, coalesce(sum(bad), 0)::DOUBLE, count(*) FILTER (n > 0), sum(n * n)::DOUBLE, coalesce(sum(bad * bad / nullif(n, 0)::DOUBLE), 0) FROM suffixes),
strengths AS (SELECT level, coalesce(bad / nullif(n, 0), 0.5) AS mean, 1 / greatest(1 / 1001.0::DOUBLE, least(0.5::DOUBLE, coalesce(CASE WHEN n > 0 AND bad > 0 AND bad < n AND n - n2 / n - (k - 1) > 0
  THEN ((x2 - bad * bad / n) / (bad / n * (1 - bad / n)) - (k - 1)) / (n - n2 / n - (k - 1)) END, 0.0))) - 1 AS s FROM sums),
by_suffix AS (SELECT suffix, (bad + s * mean) / (n + s) AS p FROM suffixes, strengths WHERE level = 'suffix'),
by_domain AS (SELECT domain, (bad + s * p) / (n + s) AS p FROM domains JOIN by_suffix USING (suffix), strengths WHERE level = 'domain'),
by_host AS (SELECT host, n, bad, n + s AS w, (bad + s * p) / (n + s) AS m FROM hosts JOIN by_domain USING (domain), strengths WHERE level = 'host'),
bounds AS (SELECT host, n, bad, m - 1.645 * sqrt(m * (1 - m) / (w + 1)) AS bound FROM by_host),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split JOIN bounds USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled, bad AS n_bad, round(bound, 6) AS bad_bound FROM ruled""".replace("TWO_LABEL_SUFFIXES", "(" + ", ".join(f"'{s}'" for s in hosts.TWO_LABEL_SUFFIXES) + ")")


@query("op10_url_filter", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return hosts.url_verdicts(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), RULES, MAX_BAD)


OP5_SQL = r"""WITH clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max(turn) AS last, arg_max(text, (turn, text)) AS reply FROM clean WHERE role = 'assistant' GROUP BY conv_id),
given AS (SELECT a.conv_id, a.last, b.reply FROM last a LEFT JOIN last b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
refused AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN reply ELSE text END AS text
  FROM clean LEFT JOIN given USING (conv_id) WHERE NOT coalesce(role = 'assistant' AND turn = last AND reply IS NULL, false)),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM clean),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM refused),
sizes AS (SELECT c.conv_id, max(c.i) AS nc, coalesce(any_value(m.nr), 0) AS nr FROM c LEFT JOIN (SELECT conv_id, max(i) AS nr FROM r GROUP BY ALL) m USING (conv_id) GROUP BY ALL),
shared AS (SELECT s.conv_id, coalesce((SELECT min(c.i) - 1 FROM c JOIN r ON c.conv_id = r.conv_id AND c.i = r.i WHERE c.conv_id = s.conv_id AND (c.role <> r.role OR c.text <> r.text)), least(nc, nr)) AS n FROM sizes s),
sides AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
drawn AS (SELECT side, conv_id, i, role, length(role) AS rl, length(text) AS tl, i <= n AS opening, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM sides JOIN shared USING (conv_id)),
spans AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY side, conv_id, opening ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + rl + 5 AS head FROM drawn)
SELECT s.conv_id, s.n AS n_prompt_turns,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'c' AND opening), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'c' AND NOT opening), '') AS chosen,
  coalesce(string_agg(head || '-' || (head + tl), ';' ORDER BY i) FILTER (side = 'c' AND NOT opening AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'r' AND NOT opening), '') AS rejected,
  coalesce(string_agg(head || '-' || (head + tl), ';' ORDER BY i) FILTER (side = 'r' AND NOT opening AND role = 'assistant'), '') AS rejected_mask
FROM shared s LEFT JOIN spans USING (conv_id) GROUP BY ALL"""


@query("op5_preference", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has single conversations, so the rejected side of each is made from its neighbour's last reply."""
    return preference.examples(preference.swapped_replies(table(spark, sf_dir, "conversations")), "conv_id")


MIN_WORDS = 50


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rules.judged(table(spark, sf_dir, "documents"), learn_from=~failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
        F.round("p_good", 6).alias("p_good"), *[r.name for r in rules.rules()],
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOKEN_LIMIT = 2048


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def remainder(id_column: str, of: int):
    """crc32 of the id as text, modulo ``of``; decides what is held out of training."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % of


PREDICT_FROM = 0.3


def quality_classifier(docs: DataFrame, labels: DataFrame) -> quality.Classifier:
    marks = labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, marks)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality_classifier(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


#: Rows of each language that the context trees are fitted on.
TRAIN_PER_LANGUAGE = 500


def language_model(docs: DataFrame) -> language.Model:
    return language.fit(language.train_rows(docs.where(remainder("doc_id", 4) != 2), TRAIN_PER_LANGUAGE))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language_model(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


RADIUS = 4


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.fingerprints(table(spark, sf_dir, "documents"), 4)
    return simhash.groups(marked, RADIUS).select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaked benchmark item and document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SOURCE_WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MOST_COPIES = 2

OP11_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 15))::BIGINT AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 2 * source_size AS cap FROM s),
levels AS (SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM w),
e AS (SELECT doc_id, size, tie, d.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS ticks
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, (('0x' || substr(md5(coalesce(source, '') || ':42'), 1, 6))::BIGINT + sum(ticks) OVER (PARTITION BY source ORDER BY size, tie, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM e)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - ticks) >> 24)) * size AS taken, source, (upto >> 24) - ((upto - ticks) >> 24) AS copies FROM p"""


@query("op11_mixing", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies_of(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MIX_SHARE, MOST_COPIES)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def audit_conditions() -> list:
    """Failures of the filters A to D on the column ``text``; E, the copies, comes after them."""
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    n_capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    return [
        mixing.word_count(F.col("text")) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * n_capitals > 5 * F.length("text"), F.col("text").rlike(r"[#$%&*|]"),
    ]


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
  (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step, bits FROM o),
g AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS state FROM s),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (state | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & state > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, g GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


@query("op12_interactions", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = interactions.failed_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), audit_conditions())
    return interactions.audit(failed, "ABCDE")


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
