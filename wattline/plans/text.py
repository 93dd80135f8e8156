"""News, retrieval and streaming-twin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import news, report, retrieval, vector_index
from wattline.plans import frames as fr
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query
from wattline.streaming import jobs


BLANKS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
#: A text without tags and unusual characters.
CLEAN = r"""regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '""" + BLANKS + r"""', ' ', 'g'), ' '), '[^\p{L}\p{N}_ .,!?;:''"()%$-]', '', 'g')"""


@query("html_strip", f"select page_id, length({CLEAN}) as n_chars, contains(lower(html), 'nav') as relevant from pages")
def html_strip(spark, sf):
    p = fr.read(spark, sf, "pages")
    return p.select("page_id", F.length(news.clean_text(F.col("html"))).cast("long").alias("n_chars"), news.relevant(F.col("html"), ["nav"]).alias("relevant"))


@query("news_titles", ctes("articles") + " select article_id, date, source from articles qualify row_number() over (partition by lower(trim(title)) order by date, article_id) = 1")
def news_titles(spark, sf):
    return news.exact_titles(fr.articles(spark, sf)).select("article_id", "date", "source")


_STOP = ", ".join(f"'{w}'" for w in news.STOP_WORDS)
_PAIRS = ctes("articles") + f""", w as (select article_id, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+')) as term from articles),
c as (select article_id, term, count(*) as n from w where length(term) >= 2 and term not in ({_STOP}) group by all),
k as (select term, sum(n) as total, count(*) as df from c group by term order by total desc, term limit 5000),
v as (select article_id, term, n, n * (ln((1 + (select count(*) from articles)) / (1 + df)) + 1) as x from c join k using (term)),
b as (select article_id, sqrt(sum(x * x)) as norm, string_agg(term || ':' || n, ' ' order by term) as bag from v group by article_id),
f as (select article_id, norm, min(article_id) over (partition by bag) as first from b),
u as (select v.article_id, term, x / norm as x from v join f using (article_id) where article_id = first),
p as (select p.article_id as a, q.article_id as b, sum(p.x * q.x) as cosine from u p join u q on p.term = q.term and p.article_id < q.article_id group by all)
select a, b, {r('cosine', 'cosine')} from p where cosine >= 0.85 union all select first, article_id, 1.0 from f where article_id > first"""


@query("near_duplicate_pairs", _PAIRS)
def near_duplicate_pairs(spark, sf):
    return rounded(news.similar_pairs(fr.articles(spark, sf)))


@query("news_process")
def news_process(spark, sf):
    return news.process(fr.articles(spark, sf), ["en", "de", "la"], body="content").select("article_id", "date", "title")


@query("daily_articles", ctes("articles") + " select date, count(*) as n, string_agg(title, ' | ' order by article_id) as titles from articles group by date")
def daily_articles(spark, sf):
    return news.daily_articles(fr.articles(spark, sf))


@query("daily_sentiment", ctes("articles") + f""", d as (select date, count(net) as n, case when count(net) >= 3 then avg(net) end as m, case when count(net) >= 3 then stddev_samp(net) end as s, case when count(net) >= 3 then avg((net > 0)::int) end as p from articles group by date),
i as (select *, avg(m) over (order by date rows 6 preceding) as ix from d)
select date, n, {r('m', 'mean')}, {r('s', 'std')}, {r('p', 'positive_share')}, {r('ix', 'index_7d')}, {r('ix - lag(ix, 14) over (order by date)', 'momentum_14d')}, case when ix > 0.1 then 1 when ix < -0.1 then -1 else 0 end as regime,
{r('case when count(ix) over z >= 10 then (ix - avg(ix) over z) / nullif(stddev_samp(ix) over z, 0) end', 'z_60d')} from i window z as (order by date rows 59 preceding)""")
def daily_sentiment(spark, sf):
    return rounded(news.daily_sentiment(fr.articles(spark, sf)))


@query("lexicon_sentiment")
def lexicon_sentiment(spark, sf):
    a = fr.articles(spark, sf).select("article_id", F.col("content").alias("full_text"))
    return news.score_sentiment(a).select("article_id", "positive", "negative", "neutral", "net", "label")


@query("sentiment_summary", ctes("articles") + f", l as (select * from articles order by date desc, article_id limit 20) select {r('avg(net)', 'mean')}, list(title order by -abs(net), article_id)[1:5] as headlines, case when avg(net) > 0.1 then 'positive' when avg(net) < -0.1 then 'negative' else 'neutral' end as regime from l")
def sentiment_summary(spark, sf):
    return rounded(report.sentiment_summary(fr.articles(spark, sf)))


@query("chunk_stats")
def chunk_stats(spark, sf):
    d = fr.read(spark, sf, "documents").select("doc_id", "text")
    return retrieval.chunk_pages(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").alias("chars"))


_TOP_SQL = """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as doc_id, round(list_cosine_similarity(cast(q.e as double[]), cast(c.embedding as double[])), 12) as score from q, embeddings c),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, round(score, 6) + 0.0 as score, cast(rank as int) as rank from k where rank <= 10"""


@query("vector_topk", _TOP_SQL)
def vector_topk(spark, sf):
    e = fr.read(spark, sf, "embeddings")
    return rounded(retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e))


@query("vector_index_exact", _TOP_SQL)
def vector_index_exact(spark, sf):
    e = fr.read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return rounded(vector_index.search(q, vector_index.build(e), exact=True))


@query("vector_index_topk")
def vector_index_topk(spark, sf):
    e = fr.read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return rounded(vector_index.search(q, vector_index.build(e)))


@query("retrieve_filtered")
def retrieve_filtered(spark, sf):
    e = fr.read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(retrieval.retrieve(q, e, where=F.col("label") < 5).select("query_id", "doc_id", "score", "rank"))


@query("qa_answers", """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as doc_id, label, round(list_cosine_similarity(cast(q.e as double[]), cast(c.embedding as double[])), 12) as score from q, embeddings c),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, 'What is like ' || query_id || '?' as question, min('Label ' || label || ' of ' || doc_id) filter (rank = 1) as answer, string_agg(doc_id::varchar, ',' order by rank) as sources from k where rank <= 5 group by query_id""")
def qa_answers(spark, sf):
    e = fr.read(spark, sf, "embeddings")
    text = F.concat(F.lit("Label "), F.col("label").cast("string"), F.lit(" of "), F.col("vec_id").cast("string"))
    corpus = e.select("vec_id", "embedding", text.alias("text"), F.lit("embeddings").alias("source"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.concat(F.lit("What is like "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"))
    return retrieval.ask(q, corpus).withColumn("sources", F.array_join("sources", ","))


@query("context_pack", "select conv_id, turn, total_chars from (select conv_id, turn, cast(sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as total_chars from conversations) where total_chars <= 1200")
def context_pack(spark, sf):
    return retrieval.pack_context(fr.read(spark, sf, "conversations"), "conv_id", "turn", max_tokens=300).select("conv_id", "turn", "total_chars")


@query("signal_parse", """with s as (select event_id, case event_id % 4 when 0 then 'BULLISH' when 1 then 'BEARISH' when 2 then 'maybe' else 'NEUTRAL' end as d, value / 100 as c from events), g as (select event_id, c, case when c < 0.65 then 'NEUTRAL' when d in ('BULLISH', 'BEARISH') then d else 'NEUTRAL' end as direction from s)
select event_id, direction, round(least(1, greatest(0, c)), 4) + 0.0 as confidence, round(case direction when 'BULLISH' then least(1, c) when 'BEARISH' then -least(1, c) else 0.0 end, 4) + 0.0 as numeric from g""")
def signal_parse(spark, sf):
    e = fr.read(spark, sf, "events")
    side = F.element_at(F.array(*[F.lit(x) for x in ("BULLISH", "BEARISH", "maybe", "NEUTRAL")]), (F.col("event_id") % 4 + 1).cast("int"))
    said = e.select("event_id", F.concat(F.lit("DIRECTION: "), side, F.lit("\nCONFIDENCE: "), F.format_string("%.6f", F.col("value") / 100), F.lit("\nREASONING: x")).alias("t"))
    out = retrieval.parse_signal("t")
    return rounded(said.select("event_id", *[out[c].alias(c) for c in ("direction", "confidence", "numeric")]), 4)


@query("table_rendering", """with t as (select *, cast(row_number() over (order by c_custkey) as int) as i, count(*) over () as n from customer)
select i as row, concat_ws(' | ', cast(c_custkey as varchar), c_name, c_mktsegment) as line from t where n <= 60 or i <= 30 or i > n - 10""")
def table_rendering(spark, sf):
    return retrieval.render_table(fr.read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


_STATISTICS = {"count": "count(x)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "25%": "quantile_cont(x, 0.25)", "50%": "quantile_cont(x, 0.5)", "75%": "quantile_cont(x, 0.75)", "max": "max(x)"}


@query("table_statistics", "with c as (select 'l_quantity' as col, cast(l_quantity as double) as x from lineitem union all select 'l_extendedprice', cast(l_extendedprice as double) from lineitem union all select 'l_tax', cast(l_tax as double) from lineitem) " + " union all ".join(f"select col as \"column\", '{k}' as statistic, {r(x, 'value', 4)} from c group by col" for k, x in _STATISTICS.items()))
def table_statistics(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    return rounded(retrieval.describe_table(fr.read(spark, sf, "lineitem").select(*columns), columns), 4)


_LATE_SQL = """with e as (select *, date_diff('day', (select min(ts) from events), ts) + case when event_id % 5 = 0 then 6 else 0 end as batch from events),
b as (select batch, max(ts) as m from e group by batch), s as (select batch, max(m) over (order by batch rows between unbounded preceding and 1 preceding) as seen from b),
k as (select batch, lag(seen) over (order by batch) - interval 2 days as mark from s),
r as (select event_type, date_trunc('day', ts) as start, value, coalesce(date_trunc('day', ts) + interval 1 day <= mark, false) as dropped from e join k using (batch)),
g as (select event_type, start, sum(value) filter (not dropped) as total, count(*) filter (not dropped) as n, count(*) filter (dropped) as n_dropped from r group by all)
select event_type, start, round(total, 6) + 0.0 as total, n, n_dropped from g"""


def late_events(spark, sf):
    """Events by arrival: a batch a day of event time, and a fifth of the rows six days later."""
    e = fr.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.agg(F.min("ts").alias("_first"))
    day = F.datediff(F.col("ts"), F.col("_first")) + F.when(F.col("event_id") % 5 == 0, 6).otherwise(0)
    return e.join(F.broadcast(first)).withColumn("batch", day).drop("_first")


@query("late_rows", _LATE_SQL)
def late_rows(spark, sf):
    out = jobs.replay(late_events(spark, sf), "batch", "value", "event_type", late="2 days")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("late_rows_closed", _LATE_SQL + " where start + interval 1 day <= (select max(ts) from events) - interval 2 days")
def late_rows_closed(spark, sf):
    out = jobs.replay(late_events(spark, sf), "batch", "value", "event_type", late="2 days", closed_only=True)
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("event_sessions", """with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from s)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from g group by user_id, g""")
def event_sessions(spark, sf):
    e = jobs.event_time(fr.read(spark, sf, "events"))
    out = jobs.sessions(e, "user_id", watermark=False)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("sliding_index", f"""with w as (select unnest(generate_series(0, 6)) as k), e as (select cast(ts as date) - cast(k as int) as s, value from events, w) select cast(s + 7 as timestamp) as at, {r('avg(value)', 'index')}, count(*) as n from e group by s""")
def sliding_index(spark, sf):
    e = jobs.event_time(fr.read(spark, sf, "events"))
    return rounded(jobs.sliding_index(e, "value", watermark=False).withColumn("at", F.col("at").cast("timestamp_ntz")))


@query("tumbling_daily", f"select event_type, cast(cast(ts as date) as timestamp) as day, {r('sum(value)', 'total', 4)}, max(value) as peak, count(value) as n from events group by event_type, cast(ts as date)")
def tumbling_daily(spark, sf):
    e = jobs.event_time(fr.read(spark, sf, "events"))
    return rounded(jobs.tumbling_daily(e, "value", "event_type", watermark=False).withColumn("day", F.col("day").cast("timestamp_ntz")), total=4)
