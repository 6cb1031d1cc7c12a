"""The library's queries, and DuckDB SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winnowry.functions import stopwords
from winnowry.functions.text import SPACE, words
from winnowry.operators import classify, dedup, learned, paragraphs
from winnowry.plans import evaluate, extract, output

LANGUAGES = ("en", "fr", "de", "es")


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_lists() -> dict[str, list[str]]:
    return {code: stopwords.words(code) for code in LANGUAGES}


def lines(spark, sf_dir):
    return paragraphs.from_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def line_features(spark, sf_dir):
    rows = classify.features(lines(spark, sf_dir), stop_lists(), "lang")
    return rows.select(F.col("page_id").alias("doc_id"), "idx", F.col("length").cast("bigint").alias("length"), F.col("words").cast("bigint").alias("words"), F.col("stopwords").cast("bigint").alias("stopwords"), F.round("stopword_density", 6).alias("stopword_density"))


def classified_lines(spark, sf_dir):
    t = classify.Thresholds()
    return classify.in_context(classify.context_free(classify.features(lines(spark, sf_dir), stop_lists(), "lang"), t), t)


def line_classes(spark, sf_dir):
    return classified_lines(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "idx", "cf_class", "class_type")


def line_documents(spark, sf_dir):
    rows = output.document_text(classified_lines(spark, sf_dir))
    return rows.select(F.col("page_id").alias("doc_id"), F.md5("text").alias("text_md5"), F.char_length("text").cast("bigint").alias("chars"))


def line_duplicates(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("class_type", F.lit("good"))
    return dedup.duplicate_counts(rows).select(F.col("page_id").alias("doc_id"), "n")


def length_percentiles(spark, sf_dir):
    return evaluate.percentiles(read(spark, sf_dir, "documents"), "n_chars")


def language_breakdown(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluate.breakdown(rows, "lang", "n_chars").select("lang", "n", F.round("mean", 6).alias("mean"), "median")


def length_summary(spark, sf_dir):
    return evaluate.summarize(read(spark, sf_dir, "documents"), ["n_chars"], ["source"]).withColumn("n_chars_mean", F.round("n_chars_mean", 6))


def density_histogram(spark, sf_dir):
    rows = classify.features(lines(spark, sf_dir), stop_lists(), "lang")
    return evaluate.histogram(rows, "stopword_density")


def longest_documents(spark, sf_dir):
    return evaluate.best(read(spark, sf_dir, "documents"), "n_chars", 20, "doc_id").select("doc_id", "n_chars")


def turns(spark, sf_dir):
    """Each turn against the one before it."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return t.select("conv_id", "turn", F.col("text").alias("pred"), F.lag("text").over(w).alias("gold")).where("gold is not null")


def turn_tags(spark, sf_dir):
    share = F.least(F.char_length("pred") / F.greatest(F.char_length("gold"), F.lit(1)), F.lit(1.0))
    rows = turns(spark, sf_dir).withColumn("tags", evaluate.failure_tags(F.col("pred"), F.col("gold"), share, F.lit(None).cast("string")))
    return rows.groupBy(evaluate.primary_tag(F.col("tags")).alias("tag")).agg(F.count("*").alias("n"))


def turn_scores(spark, sf_dir):
    rows = evaluate.score(turns(spark, sf_dir))
    return rows.select("conv_id", "turn", "rougeL_p", "rougeL_r", "rougeL_f", "lev_distance", "lev_similarity")


def script_share(spark, sf_dir):
    html = F.col("html")
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit("(?is)<script[^>]*>(.*?)</script>"), 1), F.lit(0), lambda a, s: a + F.char_length(s))
    return read(spark, sf_dir, "pages").select("page_id", F.char_length(html).cast("bigint").alias("chars"), scripts.cast("bigint").alias("script_chars"), extract.needs_javascript(html, F.lit(0)).alias("flagged"))


def extract_text(spark, sf_dir):
    return extract.extract(read(spark, sf_dir, "pages"))


def page_paragraphs(spark, sf_dir):
    rows = extract.classified(read(spark, sf_dir, "pages"), variants=False)
    return rows.select("page_id", "idx", "text", "dom_path", "xpath", "chars_in_links", "cf_class", "class_type")


def detailed_output(spark, sf_dir):
    return output.detailed(extract.classified(read(spark, sf_dir, "pages"), variants=False))


def near_duplicate_lines(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("class_type", F.lit("good"))
    return dedup.near_duplicates(rows)


def learned_lines(spark, sf_dir):
    """A forest learns the rules' verdict from the labelled documents' lines and judges all lines."""
    rows = learned.features(classified_lines(spark, sf_dir))
    quality = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").cast("double").alias("label"))
    names = learned.columns()
    model = learned.forest(names).fit(rows.join(quality, "page_id").select("label", *names))
    return learned.apply(rows, model).select(F.col("page_id").alias("doc_id"), "idx", "class_type", F.round("keep_probability", 6).alias("keep_probability"))


QUERIES = {f.__name__: f for f in (line_features, line_classes, line_documents, line_duplicates, length_percentiles, language_breakdown, length_summary, density_histogram, longest_documents, turn_tags, turn_scores, script_share, extract_text, page_paragraphs, detailed_output, near_duplicate_lines, learned_lines)}

# DuckDB SQL, written apart from the expressions above
WS = SPACE.replace("\\x85", "\\x{85}").replace("\\xA0", "\\x{A0}")


def _stop_sql() -> str:
    quoted = lambda ws: "[" + ",".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
    return "case lang " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in stop_lists().items()) + " else []::varchar[] end"


def _lines_sql() -> str:
    return f"""
cut as (select doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as idx from documents),
lines as (select doc_id, lang, idx, regexp_replace(regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g'), '[{WS}]+', ' ', 'g') as text from cut),
f0 as (select doc_id, idx, text, length(text) as length, list_filter(regexp_split_to_array(text, ' +'), lambda w: w <> '') as ws, {_stop_sql()} as stop from lines where text <> ''),
f as (select doc_id, idx, text, length, len(ws) as words, len(list_filter(ws, lambda w: list_contains(stop, lower(w)))) as stopwords from f0),
d as (select *, case when words > 0 then stopwords::double / words else 0.0 end as density from f)"""


def _class_sql() -> str:
    return (
        _lines_sql()
        + """,
cf as (select *, case when contains(text, '©') or contains(text, '&copy') then 'bad' when length < 40 then 'short'
  when density >= 0.2 and length > 60 then 'good' when density >= 0.15 then 'neargood' else 'bad' end as cf_class from d),
a as (select *, coalesce(last_value(case when cf_class in ('good', 'bad') then cf_class end ignore nulls) over p, 'bad') as p1,
  coalesce(first_value(case when cf_class in ('good', 'bad') then cf_class end ignore nulls) over n, 'bad') as n1,
  coalesce(last_value(case when cf_class <> 'short' then cf_class end ignore nulls) over p, 'bad') as p2,
  coalesce(first_value(case when cf_class <> 'short' then cf_class end ignore nulls) over n, 'bad') as n2 from cf
  window p as (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), n as (partition by doc_id order by idx rows between 1 following and unbounded following)),
b as (select *, case when cf_class <> 'short' then cf_class when p1 = n1 then p1 when (p1 = 'bad' and p2 = 'neargood') or (n1 = 'bad' and n2 = 'neargood') then 'good' else 'bad' end as c2 from a),
c as (select *, coalesce(last_value(case when c2 in ('good', 'bad') then c2 end ignore nulls) over p, 'bad') as p3,
  coalesce(first_value(case when c2 in ('good', 'bad') then c2 end ignore nulls) over n, 'bad') as n3 from b
  window p as (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), n as (partition by doc_id order by idx rows between 1 following and unbounded following)),
final as (select *, case when c2 <> 'neargood' then c2 when p3 = 'bad' and n3 = 'bad' then 'bad' else 'good' end as class_type from c)"""
    )


def _tags_sql() -> str:
    return """with t as (select conv_id, turn, coalesce(text, '') as pred, lag(coalesce(text, '')) over (partition by conv_id order by turn, coalesce(text, '')) as gold from conversations),
m as (select *, length(pred)::double / greatest(length(gold), 1) as share, trim(pred, ' ') = '' as empty,
  length(regexp_replace(gold, '[^\\p{L}]', '', 'g')) as letters, length(regexp_replace(gold, '[^\\p{L}]|[a-zA-Z]', '', 'g')) as others,
  pred <> gold and regexp_replace(pred, '[\\s\\x{85}\\x{A0}]+', '', 'g') = regexp_replace(gold, '[\\s\\x{85}\\x{A0}]+', '', 'g') as ws from t where gold is not null)
select case when empty then 'EMPTY_PRED' when letters > 0 and others::double / letters > 0.30 then 'NON_LATIN' when ws then 'WHITESPACE' when share < 0.5 then 'UNDER_EXTRACTION'
  when share > 1.5 then 'OVER_EXTRACTION' when least(share, 1.0) < 0.95 then 'PARTIAL' else 'GOOD' end as tag, count(*) as n from m group by 1"""


def oracles() -> dict[str, str]:
    return {
        "line_features": f"with {_lines_sql()} select doc_id, idx::int as idx, length, words, stopwords, round(density, 6) as stopword_density from d",
        "line_classes": f"with {_class_sql()} select doc_id, idx::int as idx, cf_class, class_type from final",
        "line_documents": f"with {_class_sql()}, x as (select doc_id, string_agg(text, chr(10) || chr(10) order by idx) as text from final where class_type = 'good' group by doc_id) select doc_id, md5(text) as text_md5, length(text) as chars from x",
        "line_duplicates": f"with {_lines_sql()}, n as (select doc_id, idx, lower(translate(text, '‘’“”�', '''''\"\"')) as norm from d), e as (select * from n where length(norm) >= 12 and length(regexp_replace(norm, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) <= 0.13 * length(norm)), r as (select doc_id, row_number() over (partition by doc_id, norm order by idx) as k from e) select doc_id, count(*) as n from r where k > 1 group by doc_id",
        "length_percentiles": "with r as (select n_chars, row_number() over (order by n_chars) - 1 as k, count(*) over () as n from documents), p as (select unnest([5, 25, 50, 75, 95]) as percentile) select percentile::int as percentile, n_chars as value from p join r on k = round_even(percentile / 100.0 * (n - 1), 0)::bigint",
        "language_breakdown": "select lang, count(*) as n, round(avg(n_chars), 6) as mean, median(n_chars)::double as median from documents join labels using (doc_id) group by lang",
        "length_summary": "select source, count(*) as n_docs, round(avg(n_chars), 6) as n_chars_mean, median(n_chars)::double as n_chars_median, min(n_chars) as n_chars_min, max(n_chars) as n_chars_max from documents group by source",
        "density_histogram": f"with {_lines_sql()} select least(floor(density * 10), 9)::int as bin, count(*) as n from d group by 1",
        "longest_documents": "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20",
        "turn_tags": _tags_sql(),
        "script_share": "with s as (select page_id, length(html) as chars, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0)::bigint as script_chars from pages) select page_id, chars, script_chars, chars >= 20000 and script_chars::double / chars > 0.30 as flagged from s",
    }
