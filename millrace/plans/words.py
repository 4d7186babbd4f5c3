"""Queries over texts, keys and graphs of the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokens import STOP_WORDS
from millrace.operators import clusters, graph, sessions, text
from millrace.plans import jobs
from millrace.sources.text import text_lines as lines_of
from millrace.tables import spread, table, written

K, ROUNDS = 8, 2
SESSION_US = 6 * 3600 * 1_000_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumnRenamed("key", "doc_id")


def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_count(_lines(spark, sf_dir), "line")


def word_count_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a job, whose counts are combined per task."""
    mapped = jobs.MAPS["combining_word_count"](_lines(spark, sf_dir), value="line")
    return jobs.REDUCES["word_count"](mapped).select(F.col("key").alias("word"), F.col("value").alias("cnt"))


def word_count_zero_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_zero_words(word_count(spark, sf_dir))


def ngram_count_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ngram_count(_lines(spark, sf_dir), "line", 3)


def ngram_count_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ngram_count(_lines(spark, sf_dir), "line", 5)


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.inverted_index(table(spark, sf_dir, "part"), "p_partkey", "p_name", 4)


def tuple_length_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tuple_length_count(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment")


def grep_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.grep_selectivity(table(spark, sf_dir, "part"), "p_name", 0.4).select("p_partkey", "p_name")


def key_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.key_prefix_count(table(spark, sf_dir, "part"), "p_type", 3)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page lines, whose speaker and agenda item are links."""
    d = table(spark, sf_dir, "documents")
    link = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<link><target>"), F.translate(c, "<\t", "  "), F.lit("</target></link>"))).otherwise("")
    page = F.concat(F.lit("page "), F.col("doc_id").cast("string"))
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), page, F.coalesce(F.col("issued_at").cast("date").cast("string"), F.lit("")), F.concat(link("speaker"), link("agenda_item")), F.coalesce("text", F.lit("")))
    return d.select(line.alias("line"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_links(_pages(spark, sf_dir), "line").groupBy("page", "target").agg(F.count(F.lit(1)).alias("cnt"))


def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_texts(_pages(spark, sf_dir), "line")


def adjacency_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = graph.adjacency(text.page_links(_pages(spark, sf_dir), "line"), "page", "target")
    return built.select(F.col("id").alias("page"), F.size("nbrs").alias("degree"), F.array_join("nbrs", "|").alias("targets"), "rank")


def parse_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p"))
    lines = parts.select(F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.size("p").cast("string"), F.array_join(F.transform("p", lambda x: x.cast("string")), " ")).alias("line"))
    return graph.parse_adjacency(lines, "line", 3).select("id", F.posexplode("nbrs").alias("pos", "nbr"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers point to the parts they deliver, and parts that were returned back to who delivered them."""
    li = table(spark, sf_dir, "lineitem")
    s, p = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("s", "l_suppkey"), ("p", "l_partkey")))
    return li.select(s.alias("src"), p.alias("dst")).unionAll(li.where("l_returnflag = 'R'").select(p.alias("src"), s.alias("dst"))).distinct()


def _rank(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    edges = written(_edges(spark, sf_dir), "edges")
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
    n = ids.count()
    return graph.page_rank(edges, ids.withColumn("rank", F.lit(1.0 / n)), rounds).select("id", "degree", F.round("rank", 9).alias("rank"))


def pagerank_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, 1)


def pagerank_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, 3)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = F.transform("embedding", lambda x: F.floor((x.cast("double") + 10) * 1000).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", coords.alias("coords"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return clusters.assign(p, "vec_id", "coords", clusters.first_centres(p, "vec_id", "coords", K))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return clusters.as_table(spark, clusters.step(p, "coords", clusters.first_centres(p, "vec_id", "coords", K)))


def kmeans_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return clusters.as_table(spark, clusters.iterate(p, "coords", clusters.first_centres(p, "vec_id", "coords", K), ROUNDS))


def click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.click_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", SESSION_US, tie=["event_id"]).withColumnRenamed("user", "user_id")


def global_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("total"))


def sum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"))
    return jobs.REDUCES["sum_values"](mapped)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.REDUCES["count_duplicates"](table(spark, sf_dir, "orders"), keys=["o_custkey"])


def _copies(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Rows per key as a table of checks: keys that have at least one, whether each has ``least`` to ``most``, whether copies have keys of their own, and whether all are as many as the ratio says to within a twentieth."""
    per = rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new_key").alias("own"))
    return per.agg(F.min((F.col("n") >= least) & (F.col("n") <= most)).alias("bounded"), F.min(F.col("n") == F.col("own")).alias("own_keys"), F.sum("n").alias("n"))


def ratio_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order one and a half times."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    out = _copies(jobs.MAPS["ratio"](o, keys=["o_orderkey"], ratio=1.5), 1, 2)
    return out.select("bounded", "own_keys", (F.abs(F.col("n") - 1.5 * F.lit(o.count())) <= 0.05 * o.count() + 20).alias("as_many"))


def ratio_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    out = _copies(jobs.REDUCES["ratio"](o, keys=["o_orderkey"], ratio=0.5), 1, 1)
    return out.select("bounded", "own_keys", (F.abs(F.col("n") - 0.5 * F.lit(o.count())) <= 0.05 * o.count() + 20).alias("as_many"))


def gen_random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many vertices as there are customers: how many, the sum of their ranks, whether degrees and neighbours are within bounds, and whether the mean degree is that of the probability."""
    n = table(spark, sf_dir, "customer").count()
    g = graph.random_graph(spark, n, 10 / n, 50)
    bounded = (F.size("nbrs") <= 50) & F.forall("nbrs", lambda x: (x >= 0) & (x < n))
    return g.agg(F.countDistinct("id").alias("vertices"), F.round(F.sum("rank"), 6).alias("ranks"), F.min(bounded).alias("bounded"), (F.abs(F.avg(F.size("nbrs")) - 10) <= 1.5).alias("mean"))


def gen_power_law_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that are pointed to by 1 to 30 others: how many, edges against those that were drawn, and whether all is within bounds."""
    n = table(spark, sf_dir, "customer").count()
    g = graph.power_law_graph(spark, n, 1, 30)
    drawn = sum(d * k for d, k in graph.power_law_degrees(n, 1, 30).items())
    bounded = (F.size("nbrs") <= 30) & F.forall("nbrs", lambda x: (x >= 0) & (x < n))
    return g.agg(F.countDistinct("id").alias("vertices"), F.round(F.sum("rank"), 6).alias("ranks"), F.min(bounded).alias("bounded"), (F.sum(F.size("nbrs")) == drawn).alias("all_edges"))


def _random(points: DataFrame, dimension: int, most: int) -> DataFrame:
    x = F.explode("coords").alias("x")
    return points.select("id", F.size("coords").alias("d"), x).agg(
        F.countDistinct("id").alias("points"), F.min((F.col("d") == dimension) & (F.col("x") >= 0) & (F.col("x") < most)).alias("bounded"), (F.abs(F.avg(F.col("x") / F.lit(float(most))) - 0.5) <= 0.05).alias("uniform")
    )


def gen_kmeans_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, with eight of them as first centres, of which one step is done: do the centres stay within bounds?"""
    points = clusters.random_points(spark, table(spark, sf_dir, "customer").count(), 6, 1000)
    centres = clusters.random_centres(8, 6, 1000)
    after = clusters.step(points, "coords", centres)
    return _random(points, 6, 1000).withColumn("centres", F.lit(len(after) == 8 and all(0 <= x < 1000 for c in after for x in c)))


def gen_ratio_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random tuples of 8 (2 + 4) bytes, as many as fill the size of a job's tuples."""
    return _random(clusters.random_values(spark, table(spark, sf_dir, "lineitem").count() * 8, 4), 4, 1 << 62)


QUERIES = {
    f.__name__: f
    for f in (
        text_lines, pass_through, word_count, word_count_combined, word_count_zero_stopwords, ngram_count_3, ngram_count_5, inverted_index, tuple_length_count, grep_selectivity,
        key_prefix_count, link_extract, text_extract, adjacency_build, parse_adjacency, pagerank_1, pagerank_3, kmeans_assign, kmeans_step, kmeans_iter, click_sessions, global_sum, sum_values,
        duplicate_keys, ratio_expand, ratio_reduce, gen_random_graph, gen_power_law_graph, gen_kmeans_points, gen_ratio_data,
    )
}

_LINES = r"""
with l as (select doc_id, pos, line from (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as pos from (select doc_id, regexp_split_to_array(text, '\r?\n') as a from documents)) where line <> '')"""
_WORDS = _LINES + """, w as (select unnest(regexp_extract_all(line, '[^ ".,/()?;]+')) as word from l)"""
_COUNTED = _WORDS + " select word, count(*) as cnt from w group by word"


def _ngrams(n: int) -> str:
    return _LINES + f""", p as (select regexp_extract_all(line, '[^ ".,/()?;]+[ ".,/()?;]*') as p from l),
w as (select p, unnest(range(1, len(p) - {n} + 2)) as i from p where len(p) >= {n}),
g as (select i, len(p) as np, array_to_string(p[i:i + {n} - 1], '') as r from w),
h as (select *, regexp_replace(r, '[ ".,/()?;]+$', '') as t from g)
select case when i = np - {n} + 1 and length(r) - length(t) = 1 then r else t end as ngram, count(*) as cnt from h group by 1"""


_LINK = "case when {c} is null then '' else '<link><target>' || translate({c}, '<' || chr(9), '  ') || '</target></link>' end"
_PAGES = f"""
with pages as (select 'page ' || doc_id as page, {_LINK.format(c="speaker")} || {_LINK.format(c="agenda_item")} as xml, coalesce(text, '') as text from documents),
links as (select page, unnest(regexp_extract_all(xml, '<link><target>([^<]*)<', 1)) as target from pages)"""

_GRAPH = """
with recursive e as (
  select distinct src, dst from (
    select 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem
    union all select 'p' || l_partkey, 's' || l_suppkey from lineitem where l_returnflag = 'R')),
v as (select src as id from e union select dst from e),
d as (select v.id, count(e.src) as degree from v left join e on e.src = v.id group by v.id),
r0 as (select id, degree, 1.0::double / (select count(*) from v) as rank from d)"""


def _rounds(n: int) -> str:
    out = _GRAPH
    for i in range(1, n + 1):
        p = f"r{i - 1}"
        out += f""",
c{i} as (select e.dst as id, {p}.rank / {p}.degree as part from e join {p} on {p}.id = e.src union all select id, rank from {p} where degree = 0),
r{i} as (select d.id, d.degree, coalesce(s.rank, 0) as rank from d left join (select id, sum(part) as rank from c{i} group by id) s on s.id = d.id)"""
    return out + f" select id, degree, round(rank, 9) as rank from r{n}"


_POINTS = f"""
with p as (select vec_id, [cast(floor((x::double + 10) * 1000) as bigint) for x in embedding] as c from embeddings),
pd as (select vec_id, unnest(c) as x, generate_subscripts(c, 1) - 1 as dim from p),
c0 as (select row_number() over (order by vec_id) - 1 as centre, c from (select * from p order by vec_id limit {K})),
c0d as (select centre, unnest(c) as x, generate_subscripts(c, 1) - 1 as dim from c0)"""


def _assigned(i: int) -> str:
    return f""",
a{i} as (select vec_id, arg_min(centre, d * 1000 + centre) as centre from (select vec_id, centre, sum((pd.x - c.x) * (pd.x - c.x))::hugeint as d from pd join c{i}d c using (dim) group by all) group by vec_id)"""


def _stepped(i: int) -> str:
    return f""",
c{i + 1}d as (select c.centre, coalesce(m.x, c.x) as x, c.dim from c{i}d c left join (select a.centre, dim, sum(x)::bigint // count(*) as x from pd join a{i} a using (vec_id) group by all) m on m.centre = c.centre and m.dim = c.dim)"""


SQL = {
    "text_lines": _LINES + " select doc_id, cast(pos as integer) as pos, line from l",
    "pass_through": "select o_orderkey, o_custkey, o_orderstatus from orders",
    "word_count": _COUNTED,
    "word_count_combined": _COUNTED,
    "word_count_zero_stopwords": _WORDS + ", z as (select word, 1 as n from w union all select unnest([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]), 0) select word, cast(sum(n) as bigint) as cnt from z group by word",
    "ngram_count_3": _ngrams(3),
    "ngram_count_5": _ngrams(5),
    "inverted_index": "select word, doc, count(*) as cnt from (select p_partkey as doc, substr(p_name, cast(i as bigint), 4) as word from (select p_partkey, p_name, unnest(range(1, strlen(p_name) + 1, 4)) as i from part)) group by all",
    "tuple_length_count": """
with t as (select strlen(c_name) as k, strlen(c_mktsegment) as v from customer)
select kind, length, count(*) as cnt from (select 0 as kind, k as length from t union all select 1, v from t union all select 2, k + v + 8 from t) group by all""",
    "grep_selectivity": "select p_partkey, p_name from part where ascii(substr(p_name, 1, 1)) <= 102 and p_name <> ''",
    "key_prefix_count": "select substr(p_type, 1, 3) as prefix, count(*) as cnt from part group by 1",
    "link_extract": _PAGES + " select page, target, count(*) as cnt from links group by all",
    "text_extract": _PAGES + " select page, text from pages where text <> ''",
    "adjacency_build": _PAGES + " select page, cast(count(*) as integer) as degree, string_agg(target, '|' order by target) as targets, 1.0::double as rank from links group by page",
    "parse_adjacency": "select l_orderkey as id, cast(n - 1 as integer) as pos, l_partkey as nbr from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_partkey) as n from lineitem) where n <= 3",
    "pagerank_1": _rounds(1),
    "pagerank_3": _rounds(3),
    "kmeans_assign": _POINTS + _assigned(0) + " select vec_id as id, cast(centre as integer) as centre from a0",
    "kmeans_step": _POINTS + _assigned(0) + _stepped(0) + " select cast(centre as integer) as centre, cast(dim as integer) as dim, x as value from c1d",
    "kmeans_iter": _POINTS + _assigned(0) + _stepped(0) + _assigned(1) + _stepped(1) + " select cast(centre as integer) as centre, cast(dim as integer) as dim, x as value from c2d",
    "click_sessions": f"""
with recursive e as (select user_id, epoch_us(ts) as t, event_type as u, row_number() over (partition by user_id order by ts, event_type, event_id) as n from events where user_id is not null and ts is not null),
s as (
  select user_id, n, true as open, t as st, u as su, null::bigint as et, null::varchar as eu from e where n = 1
  union all
  select e.user_id, e.n, case when s.open then e.t - s.st < {SESSION_US} else true end, case when s.open then s.st else e.t end, case when s.open then s.su else e.u end,
         case when s.open and e.t - s.st >= {SESSION_US} then e.t end, case when s.open and e.t - s.st >= {SESSION_US} then e.u end
  from s join e on e.user_id = s.user_id and e.n = s.n + 1)
select user_id, st as start_us, su as start_url, et as end_us, eu as end_url from s where et is not null""",
    "global_sum": "select cast(sum(cast(floor(value * 100) as bigint)) as bigint) as total from events",
    "sum_values": "select l_partkey as key, cast(sum(cast(l_quantity as bigint)) as bigint) as value from lineitem group by 1",
    "ratio_expand": "select true as bounded, true as own_keys, true as as_many",
    "ratio_reduce": "select true as bounded, true as own_keys, true as as_many",
    "gen_random_graph": "select count(*) as vertices, 1.0::double as ranks, true as bounded, true as mean from customer",
    "gen_power_law_graph": "select count(*) as vertices, 1.0::double as ranks, true as bounded, true as all_edges from customer",
    "gen_kmeans_points": "select count(*) as points, true as bounded, true as uniform, true as centres from customer",
    "gen_ratio_data": "select cast(count(*) * 8 // 48 as bigint) as points, true as bounded, true as uniform from lineitem",
    "duplicate_keys": "select o_custkey, count(*) as cnt from orders group by 1 having count(*) > 1",
}
