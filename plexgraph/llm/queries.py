"""One query for each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm import alignment, bpe, factorisation, hard_negatives, langid, media, minhash_dedup, mixing, pseudo_likelihood, quality, suffix_dedup, toxicity, urls
from plexgraph.llm.runtime import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs).select("doc_id", "class_id", "class_size", "representative")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.default_vocabulary()
    rows = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "token_ids")
    rows = bpe.decode(rows, path).withColumn("id_text", bpe.id_text_column(path)("token_ids"))
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.col("id_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out(parts=3, part=1)
    field = langid.fit(docs.where(~held))
    return langid.predict(docs, field).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_features(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = F.concat_ws(";", F.transform(F.arrays_zip("times", "codes"), lambda x: F.concat_ws(":", x["times"], x["codes"])))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.size("times").cast("string"), F.lit(":"), F.sha2(pairs.cast("binary"), 256)).alias("feature"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of the pages whose id is divisible by 50."""
    url = urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    return pages.where("page_id % 50 = 0").select(url.alias("url"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = pseudo_likelihood.train(docs.select("text"))
    return pseudo_likelihood.score(docs, network).select("doc_id", "n_words", "pll", "mean_pll")


def op11_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    machine = factorisation.fit(docs, labels.where(~toxicity.held_out()))
    rows = factorisation.score(docs, machine)
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = stored(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", groups.alias("groups_sha256"), "pairs", "links"), "aligned")
    counted = alignment.with_counts(rows, stored(alignment.pair_counts(rows), "pair-counts"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, number = F.col("label").cast("long"), F.col("vec_id")
    label = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_bpe, op3_toxicity, op4_language_id, op5_mixing, op6_media, op7_url_filter, op8_suffix_dedup, op9_quality, op10_pseudo_likelihood, op11_factorisation, op12_alignment, op13_hard_negatives, pipeline)}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PUNCTUATION = "'" + quality.PUNCTUATION.replace("'", "''") + "'"
_CANONICAL = """case when host <> '' then regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') end"""

ORACLE_SQL = {
    "op5_mixing": r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
totals as (select source, sum(size)::double as source_size from sized group by source),
numbered as (select *, row_number() over (order by source nulls last) - 1 as k from totals),
shared as (select *, [3.0, 1.0, 2.0][k % 3 + 1]::double as share, [-0.5, 0.0, 0.5][k % 3 + 1]::double as a, 2.0 * source_size as most from numbered),
levels as (select *, (1.5 * sum(source_size) over () - coalesce(sum(most) over w, 0)) / (sum(share) over () - coalesce(sum(share) over w, 0)) as level
  from shared window w as (order by most / share, k rows between unbounded preceding and 1 preceding)),
goals as (select source, source_size, a, least(share * coalesce(max(case when level <= most / share then level end) over (), 0), most) as target from levels),
placed as (select d.*, source_size, a, target, sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size / 2 as middle,
    case when source_size > 0 then floor(target / source_size) else 0 end as passes
  from sized d join goals g on d.source is not distinct from g.source),
counted as (select *, passes + case when middle <= target - passes * source_size and size > 0 then 1 else 0 end as copies, least(middle / target, 1.0) as q from placed)
select doc_id, size, source_size::bigint as source_size, target, (copies * size)::bigint as taken,
  case when copies > 0 and target > 0 then case when a = 0 then q else (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * q)) / (2 * a) end end as position
from counted""",
    "op7_url_filter": f"""
with parts as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
forms as (select *, {_CANONICAL} as form from parts),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from forms)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when form in (select form from forms where page_id % 50 = 0 and form is not null) then 'block' else 'allow' end as verdict
from ruled""",
    "op9_quality": f"""
with split_words as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i : i + {quality.RUN - 1}], ' ') as run from (select doc_id, words, unnest(range(1, len(words) - {quality.RUN} + 2)) as i from split_words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + j) as n from twice, (select unnest(range({quality.RUN})) as j) group by doc_id),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dup, count(*) filter (where left(ltrim(line, {_SPACES}), 1) in ('-', '*', '•')) as bullets,
    count(*) filter (where rtrim(line, {_SPACES}) like '%...' or rtrim(line, {_SPACES}) like '%…') as ellipses, count(*) filter (where length(line) < {quality.SHORT_LINE}) as short from (select doc_id, unnest(string_split(body, chr(10))) as line from split_words) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
measured as (
  select s.doc_id, len(words) as n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n, 0) as n_repeat_words, coalesce(bullets, 0) as bullets, coalesce(ellipses, 0) as ellipses, coalesce(short, 0) as short,
    len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))}], trim(lower(w), {_PUNCTUATION})))) as n_stop
  from split_words s left join covered c on s.doc_id = c.doc_id left join lines l on s.doc_id = l.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and word_chars / n_words between 1.5 and 25 and n_symbols / word_chars <= 0.1 and (n_stop / n_words >= 0.06 or n_words < 20)
    and (n_lines = 0 or (n_dup_lines / n_lines <= 0.5 and bullets / n_lines <= 0.9 and ellipses / n_lines <= 0.3 and (short / n_lines <= 0.8 or n_words < 20))) as kept
from measured""",
    "op13_hard_negatives": f"""
with part as (
  select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.k as a_k, a.vec_id as anchor_id, a.label = b.label as same, b.k as b_k, b.vec_id as id, list_dot_product(a.v, b.v)::bigint as score
  from part a join part b on a.k <> b.k and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
best as (select * from scored where same qualify row_number() over (partition by a_k order by score desc, id nulls last, b_k) <= {hard_negatives.POSITIVES}),
fit as (
  select p.a_k, p.anchor_id, p.b_k, p.id as positive_id, p.score as positive_score, n.id as negative_id, n.score as negative_score,
    row_number() over (partition by p.a_k, p.b_k order by n.score desc, n.id nulls last, n.b_k) as rank
  from best p join scored n on p.a_k = n.a_k and not n.same and {hard_negatives.LOW} * p.score <= 100 * n.score and 100 * n.score <= {hard_negatives.HIGH} * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from fit where rank <= {hard_negatives.NEGATIVES}""",
}
