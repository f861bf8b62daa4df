"""The numbered text queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TREE_WEIGHTS = {"domain": {"d0": 3, "d1": 2, "*": 1}, "lang": {"en": 4, "*": 2}, "source": {"*": 1}}


def tree() -> dict:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1)
    return {"domain": F.concat(F.lit("d"), F.when(number == "", "x").otherwise((number.try_cast("bigint") % 4).cast("string"))), "lang": F.col("lang"), "source": F.col("source")}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .learn import fold, in_fold
    from .quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality_scores(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .learn import fold, in_fold
    from .toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity_scores(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language, identify
    from .learn import fold, in_fold

    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, fold("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    n_bytes, n_kept = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - n_kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "padded_length")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count

    out = mix(table(spark, sf_dir, "documents"), tree(), TREE_WEIGHTS, budget_share=0.8, max_epochs=3)
    levels = {k: F.coalesce(c, F.lit("(none)")).alias(k) for k, c in tree().items()}
    return out.select("doc_id", *levels.values(), word_count().alias("n_tokens"), "epoch")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_audit

    out = filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("collapsed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality, op3_toxicity, op4_suffix_dedup, op5_packing, op6_embeddings, op7_language, op8_simhash, op9_quality_rules, op10_mixing, op11_filter_audit, op12_token_counts, op13_periodic_runs)}


def _share_sql(name: str, children: str, parents: list[str], level: str) -> str:
    """CTEs that split each parent's budget over its children by weight, none above its cap."""
    by = ", ".join(parents) or "1"
    near = f"PARTITION BY {by} ORDER BY cap / w, {level}"
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({near} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(w) OVER ({near} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {children} WHERE w > 0),
{name}_b AS (SELECT *, cap * open <= w * (budget - taken) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {by}), 0) AS rest, sum(w) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS wide FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN is_full THEN cap ELSE w * rest // wide END AS got FROM {name}_c),
{name}_e AS (SELECT *, rest - sum(got) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS odd, row_number() OVER (PARTITION BY {by}, is_full ORDER BY {level}) AS place FROM {name}_d),
{name} AS (SELECT {", ".join([*parents, level])}, got + CASE WHEN NOT is_full AND place <= odd THEN 1 ELSE 0 END AS budget FROM {name}_e)"""


def _weight_sql(level: str, weights: dict[str, dict[str, int]]) -> str:
    known = dict(weights.get(level, {}))
    default = known.pop("*", 1)
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in known.items())
    return f"CAST(CASE {level}{cases} ELSE {default} END AS HUGEINT)" if cases else f"CAST({default} AS HUGEINT)"


def mix_sql(weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int) -> str:
    one, two, three = (_weight_sql(level, weights) for level in ("domain", "lang", "source"))
    return rf"""WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\d+)$', 1) = '' THEN 'dx' ELSE 'd' || CAST(CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(CASE WHEN least({one}, {two}, {three}) > 0 THEN n_tokens ELSE 0 END) AS HUGEINT) * {max_epochs} AS able FROM docs GROUP BY ALL),
one AS (SELECT domain, sum(able) AS cap, {one} AS w, (SELECT least(CAST(floor(sum(tokens) * {budget_share!r}::DOUBLE) AS HUGEINT), sum(able)) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_share_sql("b1", "one", [], "domain")},
two AS (SELECT l.domain, lang, sum(able) AS cap, {two} AS w, any_value(b1.budget) AS budget FROM leaves l JOIN b1 ON b1.domain = l.domain GROUP BY l.domain, lang),
{_share_sql("b2", "two", ["domain"], "lang")},
three AS (SELECT domain, lang, source, able AS cap, {three} AS w, b2.budget FROM leaves l JOIN b2 USING (domain, lang)),
{_share_sql("b3", "three", ["domain", "lang"], "source")},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM leaves l JOIN b3 USING (domain, lang, source)),
placed AS (SELECT docs.*, whole, rest, md5('17:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM docs JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u) <= rest THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM taken WHERE times > 0"""


MIX_SQL = mix_sql(TREE_WEIGHTS, 0.8, 3)


RULES_SQL = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, t, string_split(t, chr(10)) AS split, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, strlen(t) AS bytes FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
spots AS (SELECT row, unnest(range(1, greatest(len(words) - 1, 1))) AS i, words FROM docs WHERE len(words) >= 3),
three AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM spots),
again AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, i + unnest([0, 1, 2]) AS j FROM three WHERE n > 1) GROUP BY row),
counted AS (SELECT docs.*, list_filter(split, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower,
  bytes - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS other, bytes - (length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))) AS inked FROM docs LEFT JOIN again ON again.row = docs.row),
judged AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words OR (n_dup_lines >= 2 AND n_dup_lines > 0.3::DOUBLE * len(lines)) OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)
    OR upper::DOUBLE / greatest(1, upper + lower) > 0.3::DOUBLE OR (upper + lower + other)::DOUBLE / greatest(1, inked) < 0.6::DOUBLE OR len(list_distinct(words)) < 0.1::DOUBLE * least(n_words, 500)) AS kept FROM judged"""


VECTORS_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS size FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
good AS MATERIALIZED (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND size > 0 AND isfinite(size) AND len(list_filter(x, lambda a: a IS NULL)) = 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN part ON part.a = v.vec_id"""


REPEATS_SQL = """WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spots AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS i FROM docs WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM spots) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM later)) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS begins, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, CAST(n_spans AS BIGINT) + 1), lambda k: CASE WHEN k = 0 THEN substr(h, 1, 2 * begins[1]) WHEN k = n_spans THEN substr(h, 2 * ends[n_spans] + 1) ELSE substr(h, 2 * ends[k] + 1, 2 * (begins[k + 1] - ends[k])) END), '') END AS k FROM docs d LEFT JOIN cuts c ON c.doc_id = d.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept"""


AUDIT_SQL = r"""WITH mark AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN mark ON mark.doc_id = d.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS removed, coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": REPEATS_SQL, "op6_embeddings": VECTORS_SQL, "op9_quality_rules": RULES_SQL, "op10_mixing": MIX_SQL, "op11_filter_audit": AUDIT_SQL}
