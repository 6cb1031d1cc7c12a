"""Queries over passes, repairs and evaluation, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from winnowry import queries
from winnowry.functions import text
from winnowry.operators import classify
from winnowry.page_queries import BASE_SQL, base_lines
from winnowry.plans import evaluate


def placed_lines(spark, sf_dir):
    """Lines of documents as if headings, list items, table rows, options and links had come with them."""
    at, link = F.pmod(F.col("page_id") + F.col("idx"), F.lit(7)), F.pmod(F.col("page_id") * 3 + F.col("idx"), F.lit(11))
    path = F.when(at == 0, "body.h2").when(at == 1, "body.ul.li").when(at == 2, "body.table.tr").when(at == 3, "body.select.option").otherwise("body.p")
    n = F.char_length("text")
    rows = queries.lines(spark, sf_dir)
    return rows.withColumns({"dom_path": path, "chars_in_links": F.when(link == 0, n).when(link == 1, F.floor(n / 10).cast("int")).when(link == 2, F.floor(n / 3).cast("int")).otherwise(0)})


def _passes(spark, sf_dir, t):
    rows = classify.context_free(classify.features(placed_lines(spark, sf_dir), queries.stop_lists(), "lang", t), t)
    rows = classify.in_context(rows.withColumn("own_class", F.col("cf_class")), t)
    return rows.select(F.col("page_id").alias("doc_id"), "idx", F.round("link_density", 6).alias("link_density"), "heading", F.col("own_class").alias("cf_class"), "class_type")


def heading_passes(spark, sf_dir):
    """Classes with links, options and headings, short headings lifted after the neighbours' pass."""
    return _passes(spark, sf_dir, classify.Thresholds())


def heading_prepasses(spark, sf_dir):
    """The same with other thresholds and headings lifted before it as well."""
    return _passes(spark, sf_dir, classify.Thresholds(heading_prepass=True, max_heading_distance=120, length_low=30, length_high=90, max_link_density=0.3))


def unworded_classes(spark, sf_dir):
    """Classes where the language has no stop words."""
    t = classify.Thresholds().without_language()
    rows = classify.in_context(classify.context_free(classify.features(placed_lines(spark, sf_dir), [], None, t), t), t)
    return rows.select(F.col("page_id").alias("doc_id"), "idx", "class_type")


def _classes_sql(low=40, high=60, links=0.2, distance=200, prepass=False, stop_low=0.15, stop_high=0.2) -> str:
    near = lambda c, values, side, w: f"coalesce({side}(case when {c} in ({values}) then {c} end ignore nulls) over {w}, 'bad')"
    pair, three = "'good', 'bad'", "'good', 'bad', 'neargood'"
    windows = "window p as (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), n as (partition by doc_id order by idx rows between 1 following and unbounded following)"
    first = f"case when heading and cf = 'short' and nextgood - before - length <= {distance} then 'neargood' else cf end" if prepass else "cf"
    return f"""with {queries._lines_sql()},
w as (select *, case (doc_id + idx) % 7 when 0 then 'body.h2' when 1 then 'body.ul.li' when 2 then 'body.table.tr' when 3 then 'body.select.option' else 'body.p' end as path,
  case (doc_id * 3 + idx) % 11 when 0 then length when 1 then length // 10 when 2 then length // 3 else 0 end as linked from d),
x as (select *, linked::double / length as link_density, path = 'body.h2' as heading from w),
y as (select *, case when link_density > {links} or contains(text, '©') or contains(text, '&copy') or contains(path, 'select') then 'bad' when length < {low} then case when linked > 0 then 'bad' else 'short' end
  when density >= {stop_high} then case when length > {high} then 'good' else 'neargood' end when density >= {stop_low} then 'neargood' else 'bad' end as cf,
  coalesce(sum(length) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as before from x),
z as (select *, first_value(case when cf = 'good' then before end ignore nulls) over n as nextgood from y {windows}),
a as (select *, {first} as c1 from z),
b as (select *, {near('c1', pair, 'last_value', 'p')} as p1, {near('c1', pair, 'first_value', 'n')} as n1, {near('c1', three, 'last_value', 'p')} as p2, {near('c1', three, 'first_value', 'n')} as n2 from a {windows}),
c as (select *, case when c1 <> 'short' then c1 when p1 = n1 then p1 when (p1 = 'bad' and p2 = 'neargood') or (n1 = 'bad' and n2 = 'neargood') then 'good' else 'bad' end as c2 from b),
e as (select *, {near('c2', pair, 'last_value', 'p')} as p3, {near('c2', pair, 'first_value', 'n')} as n3 from c {windows}),
g as (select *, case when c2 <> 'neargood' then c2 when p3 = 'bad' and n3 = 'bad' then 'bad' else 'good' end as c3 from e),
h as (select *, first_value(case when c3 = 'good' then before end ignore nulls) over n as later from g {windows}),
final as (select *, case when heading and c3 = 'bad' and c1 <> 'bad' and later - before - length <= {distance} then 'good' else c3 end as class_type from h)"""


def item_rows(spark, sf_dir):
    """Each line of a document with a list mark, a number or a label before it, as rows of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = lambda t, path: F.struct(t.alias("text"), F.lit(path).alias("dom_path"))
    number = lambda i: (i % 50 + 1).cast("string")

    def rows(x, i):
        kind = F.pmod(i + F.col("doc_id"), F.lit(6))
        li = "body.ul.li"
        return (
            F.when(kind == 0, F.array(row(F.lit("-"), li), row(x, li)))
            .when(kind == 1, F.array(row(F.concat(number(i), F.lit(".")), "body.ol"), row(F.concat(number(i), F.lit(" "), x), "body.p")))
            .when(kind == 2, F.array(row(F.lit("Read more"), "body.p"), row(F.concat(F.lit("-\n"), x), "body.p")))
            .when(kind == 3, F.array(row(F.concat(number(i), F.lit(". "), number(i), F.lit(" "), x), li), row(F.lit("By"), "body.p")))
            .when(kind == 4, F.array(row(F.lit("3."), li), row(F.lit("-"), li)))
            .otherwise(F.array(row(x, "body.p")))
        )

    listed = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.flatten(F.transform(base_lines(), rows))).alias("idx", "r"))
    kept = F.when(F.pmod(F.col("idx") * 7 + F.col("page_id"), F.lit(9)) == 0, "bad").otherwise("good")
    return listed.select("page_id", F.lit(0).alias("variant"), "idx", "r.text", "r.dom_path", F.lit(False).alias("verbatim"), kept.alias("class_type"))


def list_repairs(spark, sf_dir):
    """List marks joined to their texts, doubled numbers undone, labels dropped."""
    rows = classify.drop_ui_labels(classify.fix_doubled_numbers(classify.fix_list_markers(item_rows(spark, sf_dir))))
    return rows.select(F.col("page_id").alias("doc_id"), "idx", "text", "class_type")


def _list_repairs_sql() -> str:
    li = "'body.ul.li'"
    return f"""with {BASE_SQL},
cut as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from base),
made as (select doc_id, i, case (i + doc_id) % 6 when 0 then [['-', {li}], [line, {li}]] when 1 then [[(i % 50 + 1) || '.', 'body.ol'], [(i % 50 + 1) || ' ' || line, 'body.p']]
  when 2 then [['Read more', 'body.p'], ['-' || chr(10) || line, 'body.p']] when 3 then [[(i % 50 + 1) || '. ' || (i % 50 + 1) || ' ' || line, {li}], ['By', 'body.p']] when 4 then [['3.', {li}], ['-', {li}]] else [[line, 'body.p']] end as rs from cut),
un as (select doc_id, i, unnest(rs) as r, generate_subscripts(rs, 1) as j from made),
rows as (select doc_id, row_number() over (partition by doc_id order by i, j) - 1 as idx, r[1] as text, r[2] as path from un),
r0 as (select *, case when (idx * 7 + doc_id) % 9 = 0 then 'bad' else 'good' end as class from rows),
r1 as (select *, regexp_full_match(text, '-|[0-9]{{1,3}}\\.') as bare from r0),
k1 as (select doc_id, idx, lead(bare) over w as after, lag(case when bare and path = {li} then text end) over w as mark from r1 where class = 'good' window w as (partition by doc_id order by idx)),
r2 as (select r1.doc_id, r1.idx, case when class = 'good' and bare and path = {li} and after = false then 'bad' else class end as class,
  case when class = 'good' and not bare and mark is not null then mark || ' ' || text else text end as text from r1 left join k1 using (doc_id, idx)),
r3 as (select doc_id, idx, class, regexp_replace(regexp_replace(text, '^(-|[0-9]{{1,3}}\\.)\\n([^\\s])', '\\1 \\2'), '\\n(-|[0-9]{{1,3}}\\.)\\n([^\\s])', chr(10) || '\\1 \\2', 'g') as text from r2),
r4 as (select *, nullif(regexp_extract(text, '^([0-9]{{1,3}})\\.$', 1), '') as num, nullif(regexp_extract(text, '^([0-9]{{1,3}})\\s', 1), '') as own,
  class = 'good' and nullif(regexp_extract(text, '^([0-9]{{1,3}})\\.\\s+', 1), '') is not null and regexp_extract(text, '^([0-9]{{1,3}})\\.\\s+([0-9]{{1,3}})(\\s|$)', 1) = nullif(regexp_extract(text, '^([0-9]{{1,3}})\\.\\s+([0-9]{{1,3}})(\\s|$)', 2), '') as doubled from r3),
k2 as (select doc_id, idx, coalesce(num = lead(own) over w, false) as gives, coalesce(own = lag(num) over w, false) as takes from r4 where class = 'good' window w as (partition by doc_id order by idx)),
r5 as (select r4.*, coalesce(gives, false) as gives, coalesce(takes, false) as takes, sum(case when coalesce(gives, false) or coalesce(doubled, false) then 1 else 0 end) over (partition by r4.doc_id) as hits from r4 left join k2 using (doc_id, idx)),
r6 as (select doc_id, idx, case when hits >= 2 and gives then 'bad' else class end as class,
  case when hits >= 2 and doubled then regexp_replace(text, '^([0-9]{{1,3}})\\.\\s+[0-9]{{1,3}}', '\\1.') when hits >= 2 and takes then own || '. ' || regexp_replace(text, '^[0-9]{{1,3}}\\s+', '') else text end as text from r5)
select doc_id, idx::int as idx, text, case when text in ('Read more', 'By') then 'bad' else class end as class_type from r6"""


def table_merges(spark, sf_dir):
    """Rows of long even tables become good together; each document's lines are a table, every tenth of its rows kept at first."""
    rows = queries.lines(spark, sf_dir)
    n = F.char_length("text")
    kept = F.when(F.pmod(F.col("idx"), F.lit(4)) == 1, "good").otherwise("bad")
    link = F.when(F.pmod(F.col("idx"), F.lit(13)) == 5, n).otherwise(F.lit(0))
    rows = rows.withColumns({"dom_path": F.lit("body.table.tr.td"), "xpath": F.concat(F.lit("/html[1]/body[1]/table["), (F.floor(F.col("idx") / 40) + 1).cast("string"), F.lit("]/tr["), (F.pmod(F.col("idx"), F.lit(40)) + 1).cast("string"), F.lit("]")), "length": n, "link_density": link / n, "class_type": kept})
    return classify.merge_table_rows(rows).select(F.col("page_id").alias("doc_id"), "idx", "class_type")


def _table_merges_sql() -> str:
    return f"""with {queries._lines_sql()},
r as (select doc_id, idx, length, idx // 40 as t, idx % 13 = 5 as linked, case when idx % 4 = 1 then 'good' else 'bad' end as class from d),
g as (select doc_id, t, count(*) as n, count(*) filter (class = 'good') as kept, avg(length) as mean, stddev_pop(length) as spread, list_sort(list(length))[count(*) // 2 + 1] as middle from r where not linked group by doc_id, t)
select r.doc_id, r.idx::int as idx, case when not linked and n >= 8 and kept >= 2 and middle <= 160 and spread <= 0.4 * mean then 'good' else class end as class_type from r left join g using (doc_id, t)"""


def text_repairs(spark, sf_dir):
    """Every line of every document, spoiled in ways that the repairs undo."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(base_lines()).alias("idx", "line"))
    line, put = F.col("line"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return rows.select(
        "doc_id",
        "idx",
        text.escape_angle_emails(put(line, " <a.b+c@mail.example.org> <b>")).alias("mail"),
        text.clean_wiki_markup(put("== ", line, " ==\n[[Page|", line, "]] '''bold''' {{a {{b}}}}[http://e.org ", line, "]")).alias("wiki"),
        text.xml_safe(put("\x01", line, "\x1f￾")).alias("safe"),
        text.clean_forum_date(put(", 21st  of\n", line, ", ")).alias("date"),
        text.js_unescape(put("\\'", line, "\\\"\\/\\r\\n")).alias("script"),
        text.clean_ocr_text(put(line, "\x02\n\n\n", line)).alias("ocr"),
        text.repair_mojibake(put(line, " cafÃ© â‚¬")).alias("mojibake"),
        text.decode_double_entities(put(line, " &lt;&#65;&amp;")).alias("entities"),
        text.latex_to_text(put("$\\mathrm{", line, "} \\times \\sqrt{x}^2$")).alias("formula"),
        text.normalize_whitespace(put(line, " \t ", line, " \r\n \n", line)).alias("spaces"),
        text.is_blank(put(F.when(F.char_length(line) % 2 == 0, line).otherwise("  \t"), " ")).alias("blank"),
        text.decode_html(F.encode(put("<meta charset='windows-1252'>", line, "é"), "iso-8859-1")).alias("decoded"),
    )


def _text_repairs_sql() -> str:
    nl, nbsp = "chr(10)", "chr(160)"
    return f"""with {BASE_SQL}, cut as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from base)
select doc_id, i::int as idx, line || ' &lt;a.b+c@mail.example.org&gt; <b>' as mail, line || {nl} || line || ' bold ' || line as wiki, line as safe, '21 of ' || line as date,
  '''' || line || '"/' || {nl} as script, line || {nl} || {nl} || line as ocr, line || ' café €' as mojibake, line || ' <A&' as entities, line || ' × √(x)²' as formula,
  line || ' ' || line || {nl} || line as spaces, length(line) % 2 <> 0 as blank, '<meta charset=''windows-1252''>' || line || 'é' as decoded from cut"""


def indexed_turns(spark, sf_dir):
    """Turns against the ones before them, as records of a run: numbered, with a metric."""
    rows = queries.turns(spark, sf_dir)
    # one row a conversation is numbered, not one a turn
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("conv_id", start.alias("start")), "conv_id")
    number = F.col("start") + F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pred")) - 1
    share = F.least(F.char_length("pred") / F.greatest(F.char_length("gold"), F.lit(1)), F.lit(1.0))
    common = F.size(F.array_intersect(evaluate.tokens(F.col("pred")), evaluate.tokens(F.col("gold")))) / F.greatest(F.size(F.array_distinct(evaluate.tokens(F.col("gold")))), F.lit(1))
    return rows.select(number.alias("index"), "conv_id", "turn", "pred", "gold", share.alias("share"), common.alias("common"))


INDEXED_SQL = """t as (select conv_id, turn, coalesce(text, '') as pred, lag(coalesce(text, '')) over (partition by conv_id order by turn, coalesce(text, '')) as gold from conversations),
k as (select *, [distinct_list] as words from t),
r as (select row_number() over (order by conv_id, turn, pred) - 1 as index, *, least(length(pred)::double / greatest(length(gold), 1), 1.0) as share,
  list_distinct(regexp_extract_all(lower(pred), '[\\p{L}\\p{N}_]+')) as pt, list_distinct(regexp_extract_all(lower(gold), '[\\p{L}\\p{N}_]+')) as gt from t where gold is not null),
i as (select *, len(list_intersect(pt, gt))::double / greatest(len(gt), 1) as common from r)""".replace("k as (select *, [distinct_list] as words from t),\n", "")


def run_join(spark, sf_dir):
    """Records, predictions and metrics put together by position, then searched."""
    rows = indexed_turns(spark, sf_dir)
    joined = evaluate.join_runs(rows.select("index", "conv_id", "gold"), rows.select("index", "pred"), rows.select("index", "share"))
    found = evaluate.find(joined, gold="(?i)[aeiou]{2}", pred="[a-z]", added="^[a-e]", dropped="t", predicate=F.col("share") < 1.0)
    return found.select("index", "conv_id", F.round("share", 6).alias("share"))


def run_comparison(spark, sf_dir):
    """Change of every record from one run to another."""
    rows = indexed_turns(spark, sf_dir)
    found = evaluate.compare(rows.select("index", F.col("share").alias("m")), rows.select("index", F.col("common").alias("m")), "m")
    return found.select("index", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta")))


def run_changes(spark, sf_dir):
    rows = indexed_turns(spark, sf_dir)
    return evaluate.improved_regressed(evaluate.compare(rows.select("index", F.col("share").alias("m")), rows.select("index", F.col("common").alias("m")), "m"))


def middle_turns(spark, sf_dir):
    """The 30 records around the median, and the 20 worst."""
    rows = indexed_turns(spark, sf_dir)
    some = evaluate.around_median(rows, "common", 30).select(F.lit("median").alias("part"), "index")
    return some.unionByName(evaluate.worst(rows, "common", 20).select(F.lit("worst").alias("part"), "index"))


def turn_categories(spark, sf_dir):
    """Categories and all failure tags, counted."""
    rows = indexed_turns(spark, sf_dir)
    noisy = F.col("gold").rlike("(.)\\1\\1")
    categories = rows.groupBy(evaluate.category(F.col("pred"), F.col("gold"), F.col("common"), noisy).alias("name")).agg(F.count("*").alias("n"))
    error = F.when(F.pmod("index", F.lit(50)) == 0, "failed")
    tags = evaluate.tag_counts(rows.withColumn("tags", evaluate.failure_tags(F.col("pred"), F.col("gold"), F.col("common"), error)))
    return categories.withColumn("kind", F.lit("category")).unionByName(tags.select(F.col("tag").alias("name"), "n", F.lit("tag").alias("kind")))


def overlap_labels(spark, sf_dir):
    """Each line's share of tokens that the document's other half has, and whether that keeps it."""
    rows = queries.lines(spark, sf_dir).select("page_id", "idx", "text")
    gold = rows.where("idx % 2 = 0").groupBy("page_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("gold"))
    return evaluate.oracle_labels(rows, gold, 0.5).select(F.col("page_id").alias("doc_id"), "idx", F.round("overlap", 6).alias("overlap"), "keep")


def overlap_buckets(spark, sf_dir):
    rows = queries.lines(spark, sf_dir).select("page_id", "idx", "text")
    gold = rows.where("idx % 2 = 0").groupBy("page_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("gold"))
    return evaluate.oracle_buckets(evaluate.oracle_labels(rows, gold, 0.5))


def _overlap_sql() -> str:
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"""with {queries._lines_sql()},
g as (select doc_id, list_distinct(flatten(list({words.format('text')}))) as gold from d where idx % 2 = 0 group by doc_id),
o as (select doc_id, idx, {words.format('text')} as ws, gold from d join g using (doc_id)),
p as (select doc_id, idx, case when len(ws) > 0 then len(list_filter(ws, lambda w: list_contains(gold, w)))::double / len(ws) else 0 end as overlap from o)"""


def _scores_sql() -> str:
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    # DuckDB counts bytes: letters of two bytes become signs of one that the texts don't hold
    lp, lg = (f"translate({c}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', {' || '.join(f'chr({i})' for i in (*range(1, 9), *range(14, 27)))})" for c in ("pred", "gold"))
    return f"""with recursive t as (select conv_id, turn, coalesce(text, '') as pred, lag(coalesce(text, '')) over (partition by conv_id order by turn, coalesce(text, '')) as gold from conversations),
r as (select row_number() over () as id, *, {words.format('pred')} as p, {words.format('gold')} as g from t where gold is not null),
step as (select id, 0 as i, list_transform(range(0, len(g) + 1), lambda x: 0) as best from r
  union all select s.id, s.i + 1, list_reduce(range(1, len(r.g) + 1), lambda acc, j: list_append(acc, case when r.g[j] = r.p[s.i + 1] then s.best[j] + 1 else greatest(s.best[j + 1], acc[len(acc)]) end), [0]) from step s join r using (id) where s.i < len(r.p)),
lcs as (select id, max_by(best[len(best)], i) as n from step group by id),
m as (select r.*, n::double / nullif(len(p), 0) as pr, n::double / nullif(len(g), 0) as rc, n from r join lcs using (id))
select conv_id, turn, case when len(p) = 0 and len(g) = 0 then 1.0 else coalesce(pr, 0.0) end as "rougeL_p", case when len(p) = 0 and len(g) = 0 then 1.0 else coalesce(rc, 0.0) end as "rougeL_r",
  case when len(p) = 0 and len(g) = 0 then 1.0 when n = 0 or n is null then 0.0 else 2 * pr * rc / (pr + rc) end as "rougeL_f", levenshtein({lp}, {lg})::bigint as lev_distance, 1 - levenshtein({lp}, {lg})::double / greatest(length(pred), length(gold), 1) as lev_similarity from m"""


QUERIES = {f.__name__: f for f in (queries.turn_scores, heading_passes, heading_prepasses, unworded_classes, list_repairs, table_merges, text_repairs, run_join, run_comparison, run_changes, middle_turns, turn_categories, overlap_labels, overlap_buckets)}


def oracles() -> dict[str, str]:
    columns = "select doc_id, idx::int as idx, round(link_density, 6) as link_density, heading, cf as cf_class, class_type from final"
    letters = "length(regexp_replace(gold, '[^\\p{L}]', '', 'g'))"
    return {
        "heading_passes": f"{_classes_sql()} {columns}",
        "heading_prepasses": f"{_classes_sql(30, 90, 0.3, 120, True)} {columns}",
        "unworded_classes": f"{_classes_sql(stop_low=0, stop_high=0)} select doc_id, idx::int as idx, class_type from final",
        "list_repairs": _list_repairs_sql(),
        "table_merges": _table_merges_sql(),
        "text_repairs": _text_repairs_sql(),
        "run_join": f"with {INDEXED_SQL} select index, conv_id, round(share, 6) as share from i where regexp_matches(gold, '(?i)[aeiou]{{2}}') and regexp_matches(pred, '[a-z]') and len(list_filter(pt, lambda w: not list_contains(gt, w) and regexp_matches(w, '^[a-e]'))) > 0 and len(list_filter(gt, lambda w: not list_contains(pt, w) and contains(w, 't'))) > 0 and share < 1",
        "run_comparison": f"with {INDEXED_SQL} select index, round(share, 6) as before, round(common, 6) as after, round(common - share, 6) as delta from i",
        "run_changes": f"with {INDEXED_SQL} select count(*) filter (common - share > 1e-9) as improved, count(*) filter (common - share < -1e-9) as regressed from i",
        "middle_turns": f"with {INDEXED_SQL}, k as (select index, row_number() over (order by common, index) - 1 as k, count(*) over () as n from i) select 'median' as part, index from k where k >= greatest(0, n // 2 - 15) and k < greatest(0, n // 2 - 15) + 30 union all select 'worst', index from k where k < 20",
        "turn_categories": f"""with {INDEXED_SQL}, s as (select *, length(pred)::double / greatest(length(gold), 1) as part, trim(pred, ' ') = '' as empty,
  len(list_filter(range(1, length(gold) - 1), lambda j: gold[j] = gold[j + 1] and gold[j] = gold[j + 2] and gold[j] not in (chr(10), chr(13)))) > 0 as noisy,
  case when {letters} > 0 then length(regexp_replace(gold, '[^\\p{{L}}]|[a-zA-Z]', '', 'g'))::double / {letters} else 0 end as foreign_share,
  pred <> gold and regexp_replace(pred, '[\\s\\x{{85}}\\x{{A0}}]+', '', 'g') = regexp_replace(gold, '[\\s\\x{{85}}\\x{{A0}}]+', '', 'g') as spaced from i),
tags as (select unnest(list_filter([case when index % 50 = 0 then 'ERROR' end, case when empty then 'EMPTY_PRED' end, case when foreign_share > 0.3 then 'NON_LATIN' end, case when part < 0.5 and not empty then 'UNDER_EXTRACTION' end, case when part > 1.5 then 'OVER_EXTRACTION' end,
  case when spaced then 'WHITESPACE' end, case when common >= 0.95 then 'GOOD' end, case when common < 0.95 and part >= 0.5 and part <= 1.5 then 'PARTIAL' end], lambda x: x is not null)) as name from s),
cats as (select case when noisy then 'gold-noise' when empty then 'empty' when common >= 0.95 then 'great' when part > 1.25 then 'over' when part < 0.75 then 'under' else 'partial' end as name from s)
select name, count(*) as n, 'category' as kind from cats group by name union all select name, count(*), 'tag' from tags group by name""",
        "overlap_labels": f"{_overlap_sql()} select doc_id, idx::int as idx, round(overlap, 6) as overlap, overlap >= 0.5 as keep from p",
        "overlap_buckets": f"{_overlap_sql()} select case when overlap >= 0.7 then 'content' when overlap <= 0.15 then 'noise' else 'mixed' end as bucket, count(*) as n from p group by 1",
        "turn_scores": _scores_sql(),
    }
