"""Markup and sink queries: page links and domains, text clean-up, articles rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir, stored
from ..sources import sinks as S
from ..sources.dump import scan_dump
from ..sources.fixtures import Tables, with_views
from ..streaming.ingest import IngestState, stream_ingest
from .q_relational import _LABEL_CASE, _RANK_CASE
from .registry import register

_HREF = 'href="([^"]*)"'


def _hrefs(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", F.regexp_extract_all("html", F.lit(_HREF), 1).alias("hrefs"))


@register("p6_page_links", f"""
    select page_id, pos, href from (
      select page_id, unnest(h) as href, cast(generate_subscripts(h, 1) - 1 as integer) as pos
      from (select page_id, regexp_extract_all(html, '{_HREF}', 1) h from pages) x) y""")
def p6_page_links(spark, sf_dir):
    return _hrefs(spark, sf_dir).select("page_id", F.posexplode("hrefs").alias("pos", "href"))


_DOMAIN_SQL = r"split_part(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '(?s)^.*?://', ''), '/', 1)"


@register("p8_page_domains", f"""
    select page_id, cast(row_number() over (partition by page_id order by first_pos) - 1 as integer) as pos, domain
    from (select page_id, domain, min(i) first_pos from (
            select page_id,
                   case when contains(href, '://') then {_DOMAIN_SQL.format(x='href')}
                        else {_DOMAIN_SQL.format(x='url')} end as domain, i
            from (select page_id, url, unnest(h) href, generate_subscripts(h, 1) i
                  from (select page_id, url, regexp_extract_all(html, '{_HREF}', 1) h from pages) a) b) c
          where domain <> '' group by page_id, domain) d""")
def p8_page_domains(spark, sf_dir):
    """Distinct linked domains per page in first-seen order; a relative link
    belongs to the page's own domain."""
    p = Tables(spark, sf_dir).pages
    h = p.select("page_id", "url", F.regexp_extract_all("html", F.lit(_HREF), 1).alias("hrefs"))
    own = M.domain_of("url")
    doms = F.array_distinct(F.filter(
        F.transform("hrefs", lambda x: F.when(x.contains("://"), M.domain_of(x)).otherwise(own)),
        lambda d: d != ""))
    return h.select("page_id", F.posexplode(doms).alias("pos", "domain"))


@register("p8_url_domain", f"select page_id, {_DOMAIN_SQL.format(x='url')} as domain from pages")
def p8_url_domain(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", M.domain_of("url").alias("domain"))


def _chain(x: str, cut=False) -> str:
    """The clean-up steps as one nested DuckDB expression (the balanced
    template/file/image removals are no-ops on texts without '{{' or '[[')."""
    def rr(e, pat, rep=""):
        return f"regexp_replace({e}, '{pat}', '{rep}', 'g')"

    def rp(e, a, b=""):
        return f"replace({e}, '{a}', '{b}')"
    e = x
    e = rp(e, "&lt;", "<")
    e = rp(e, "&gt;", ">")
    e = rp(e, "&nbsp;", " ")
    e = rr(e, "&(?:amp;)+", "&")
    e = rp(e, "&quot;", '"')
    e = rp(e, "&apos;", "''")
    e = rr(e, r"(?s)\[\[Category:.*?\]\]")
    e = rr(e, r"(?s)\[http://.*?\]")
    e = rr(e, r"(?s)\{\|.*?\}")
    e = rr(e, r"(?s)<!--.*?-->")
    for tag, ends in M.HTML_BLOCKS:
        e = rr(e, "(?s)" + tag + ".*?(?:" + "|".join(ends) + ")")
    e = rr(e, "(?:'''''')+")
    e = rr(e, "(?s)==.*?==")
    e = rr(e, "(?s)===.*?===")
    e = rr(e, " {2,}", " ")
    e = rp(e, '"')
    e = rr(e, "(?:'''')+")
    e = rp(e, "&")
    e = rr(e, r"\.{2,}", ".")
    e = rp(e, "=", " ")
    if cut:
        e = f"split_part({e}, '*', 1)"
    e = rp(e, "#")
    e = rr(e, r"(?s)\(;.*?\)")
    e = rp(e, "—")
    pat = r"\(\)"
    for _ in range(7):
        pat = r"\((?:" + pat + r")*\)"
    e = rr(e, "(?:" + pat + ")+")
    e = rp(e, ".", ". ")
    e = rr(e, r"\.   ", ".  ")
    e = rr(e, r"\[\[[^\[\]]*\|")
    e = rr(e, r"(?:\]\])+")
    e = rr(e, r"(?:\[\[)+")
    e = rp(e, "\n")
    e = rp(e, "\\")
    e = rp(e, "\t")
    return rr(e, r"^\s+|\s+$")


@register("f15_cut_at_bullet", f"select doc_id as id, {_chain('text', True)} as text from documents")
def f15_cut_at_bullet(spark, sf_dir):
    """The clean-up with the cut at the first bullet."""
    d = Tables(spark, sf_dir).documents
    return d.select(F.col("doc_id").alias("id"), M.clean_text("text", truncate_at_bullet=True).alias("text"))


@register("p13_clean_text", f"select doc_id as id, {_chain('text')} as text from documents")
def p13_clean_text(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select(F.col("doc_id").alias("id"), M.clean_text("text").alias("text"))


_NOW = dt.datetime(2020, 1, 1)
_ARTICLES = """
    select t.id, replace(t.title, '''', '&squot') as title,
           coalesce(replace(c.cats, '''', '&squot'), 'NONE') as categories,
           'NONE' as cited_domains, 'NONE' as cited_authors,
           coalesce(q.quality, 'N/A') as quality, coalesce(i.importance, 'N/A') as importance,
           timestamp '2020-01-01 00:00:00' as created_at, timestamp '2020-01-01 00:00:00' as updated_at,
           replace(replace(t.title, ' ', '_'), '''', '&squot') as slug
    from (select * from w_titles where id < 1000000000) t
    left join (select c.id, string_agg(ct.title, ' | ' order by c.category_id) cats
               from w_categories c join w_titles ct on c.category_id = ct.id group by c.id) c on t.id = c.id
    left join w_quality q on t.id = q.id
    left join w_importance i on t.id = i.id"""


def _articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    arts = t.w_titles.where(F.col("id") < 1_000_000_000)
    return S.articles_projection(arts, categories=t.w_categories.withColumn("pos", F.col("category_id")),
                                 quality=t.w_quality, importance=t.w_importance, now=F.lit(_NOW),
                                 all_titles=t.w_titles)


@register("s14_articles_projection", with_views(_ARTICLES, "w_titles", "w_categories", "w_quality", "w_importance"))
def s14_articles_projection(spark, sf_dir):
    return _articles(spark, sf_dir)


@register("s15_update_source_quality", with_views(f"""
    select a.id, a.categories, a.quality, sq.source_quality
    from ({_ARTICLES}) a left join (
      select id, {_LABEL_CASE} as source_quality
      from (select l.id, sum(q.r) s, count(*) n
            from w_links l join (select id, {_RANK_CASE} r from w_quality) q on l.link_id = q.id
            where q.r is not null group by l.id) z) sq on a.id = sq.id""",
                                                  "w_titles", "w_categories", "w_quality", "w_importance",
                                                  "w_links"))
def s15_update_source_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sq = Q.source_quality(t.w_links, t.w_quality).select("id", "source_quality")
    upd = S.update_columns(_articles(spark, sf_dir), sq, cols=["source_quality"], touch=None)
    return upd.select("id", "categories", "quality", "source_quality")


@register("s13_links_tsv", with_views("""
    select cast(id as varchar) || chr(9) || string_agg(cast(link_id as varchar), ' ' order by pos, link_id) as value
    from w_links group by id""", "w_links"))
def s13_links_tsv(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.to_tsv_lines(S.keyed_lists(t.w_links))


_TABBED = "case when id % 7 = 0 then concat(title, chr(9), 'tab', chr(10), 'line') else title end"


@register("t2_sorted_export", with_views("""
    select cast(id as bigint) id, case when id % 7 = 0 then title || ' tab line' else title end title, true in_range from w_titles""", "w_titles"))
def t2_sorted_export(spark, sf_dir):
    """All titles exported as sorted part files and read back: every line within the keys that the
    manifest states for its file, every file after the one before."""
    t = Tables(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    manifest = S.export_sorted(t.w_titles.select("id", F.expr(_TABBED).alias("title")), path, "id")
    w = Window.orderBy("file")  # one row a part file
    ranges = manifest.select("file", "first_key", "last_key", F.coalesce(F.lag("last_key").over(w) <= F.col("first_key"), F.lit(True)).alias("after"))
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t").alias("f"))
    return (lines.where(F.size("f") == 2).select("file", F.col("f")[0].cast("long").alias("id"), F.col("f")[1].alias("title")).join(ranges, "file")
            .select("id", "title", (F.col("after") & F.col("id").between(F.col("first_key"), F.col("last_key"))).alias("in_range")))


# Wiki text derived from the tables: one page per order, one link and one
# category tag per line item, in line order.  Extraction must give back the
# line items: the link/category parsers run over whole pages at table scale.
_WIKI_PAGES = """
    select l_orderkey id,
           concat_ws(' ', transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))),
                     x -> concat('See [[part ', cast(x.l_partkey as string), '|the part]] and ',
                                 '[[Category:Supplier ', cast(x.l_suppkey as string), '|key]].'))) raw_text
    from {lineitem} group by l_orderkey"""


@register("p5_p6_extract_wikitext", """
    select l_orderkey as id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as integer) as pos,
           concat('Part_', cast(l_partkey as varchar)) as link,
           concat('Category:Supplier_', cast(l_suppkey as varchar)) as category
    from lineitem""")
def p5_p6_extract_wikitext(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pages = spark.sql(_WIKI_PAGES, lineitem=t.lineitem)
    z = F.arrays_zip(M.extract_links("raw_text").alias("link"), M.extract_categories("raw_text").alias("category"))
    return pages.select("id", F.posexplode(z).alias("pos", "x")).select("id", "pos", "x.link", "x.category")


# (braces are doubled: spark.sql formats the text like str.format)
# Talk pages derived from the rating roles: per part, a first WikiProject
# template with class and importance, a commented-out one, and a second
# template whose importance comes from the part key.
_TALK_PAGES = """
    select q.id,
           concat('{{{{WikiProject Parts|class= ', upper(q.quality), ' |importance=', i.importance, '}}}}',
                  '&lt;!-- {{{{WikiProject Hidden|class=FA|importance=top}}}} --&gt;',
                  '{{{{WikiProject Keys|importance=',
                  case q.id % 4 when 0 then 'Low' when 1 then 'mid' when 2 then 'HIGH' else 'top' end, '}}}}') raw
    from {w_quality} q join {w_importance} i on q.id = i.id"""


@register("p10_p11_talk_ratings", with_views("""
    select id, case when lower(quality) in ('fa','a','ga','bplus','b','c','start','stub','fl','list')
                    then lower(quality) else 'unknown' end as quality,
           case cast(floor(avg(r) + 0.5) as integer) when 0 then 'low' when 1 then 'mid' when 2 then 'high'
                when 3 then 'top' end as importance
    from (select q.id, q.quality,
                 unnest([case i.importance when 'low' then 0 when 'mid' then 1 when 'high' then 2 when 'top' then 3 end,
                         q.id % 4]) r
          from w_quality q join w_importance i on q.id = i.id) x
    group by id, quality""", "w_quality", "w_importance"))
def p10_p11_talk_ratings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pages = spark.sql(_TALK_PAGES.replace("{w_quality}", "{q}").replace("{w_importance}", "{i}"),
                      q=t.w_quality, i=t.w_importance)
    talk = pages.select("id", M.clean_talk("raw").alias("t"))
    return talk.select("id", M.extract_quality("t").alias("quality"), M.extract_importance("t").alias("importance"))


# Citation pages derived from orders: one page per order, one citation per
# line item (domains repeat inside an order; authors written 'last, first').
_CITE_PAGES = """
    select l_orderkey id,
           concat_ws(' ', transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))),
                     x -> concat('text {{{{cite web |url= http://s', cast(x.l_suppkey % 10 as string),
                                 '.example.com/p/', cast(x.l_partkey as string),
                                 ' |author=Smith', cast(x.l_suppkey % 7 as string), ', J. |title=T}}}}'))) raw
    from {lineitem} group by l_orderkey"""


@register("p7_p9_citations", """
    with c as (select l_orderkey id,
                      row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) ln,
                      concat('s', cast(l_suppkey % 10 as varchar), '.example.com') d,
                      concat('J._Smith', cast(l_suppkey % 7 as varchar)) a from lineitem),
    dd as (select id, d, min(ln) f from c group by id, d),
    aa as (select id, a, min(ln) f from c group by id, a)
    select id, 'domain' as kind, cast(row_number() over (partition by id order by f) - 1 as integer) as pos, d as value from dd
    union all
    select id, 'author', cast(row_number() over (partition by id order by f) - 1 as integer), a from aa""")
def p7_p9_citations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pages = spark.sql(_CITE_PAGES, lineitem=t.lineitem)
    cites = pages.select("id", M.extract_citations("raw").alias("c"))
    doms = cites.select("id", F.lit("domain").alias("kind"), F.posexplode(M.extract_domains("c")).alias("pos", "value"))
    auth = cites.select("id", F.lit("author").alias("kind"), F.posexplode(M.extract_authors("c")).alias("pos", "value"))
    return doms.unionByName(auth)


def _page_xml(docs):
    """Documents as ``<page>`` elements; of every 50 one has a broken text, one no id, and one comes
    after the beginning of a page that is never closed."""
    text = F.coalesce("text", F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    role = F.col("doc_id") % 50
    return docs.select(F.concat(
        F.when(role == 7, "  <page>\n    <title>Lost page</title>\n    <ns>0</ns>\n").otherwise(""),
        F.lit("  <page>\n    <title>Document "), F.col("doc_id").cast("string"), F.lit("</title>\n    <ns>0</ns>\n"),
        F.when(role == 5, "").otherwise(F.concat(F.lit("    <id>"), F.col("doc_id").cast("string"), F.lit("</id>\n"))),
        F.when(role % 10 == 9, F.concat(F.lit("    <redirect title=\"document "), (F.col("doc_id") - 1).cast("string"), F.lit("\" />\n"))).otherwise(""),
        F.lit("    <revision>\n      <id>1</id>\n      <timestamp>2010-01-01T00:00:00Z</timestamp>\n      <text xml:space=\"preserve\">"),
        F.when(role == 3, F.lit("<b>")).otherwise(""), text, F.lit("</text>\n    </revision>\n  </page>")).alias("value"))


@register("s1_dump_scan", """
    with d as (select doc_id, doc_id % 50 as part, regexp_replace(coalesce(text, ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') t from documents)
    select case when part not in (3, 5) then doc_id end id, case when part not in (3, 5) then 'Document_' || doc_id end title,
      case when part not in (3, 5) and part % 10 = 9 then 'Document_' || (doc_id - 1) end redirect,
      case when part not in (3, 5) then md5(t) end text_md5,
      case part when 3 then 'malformed' when 5 then 'no id' end problem from d
    union all select null, null, null, null, 'unclosed' from d where part = 7""")
def s1_dump_scan(spark, sf_dir):
    """All documents written as a dump and scanned again, broken pages with their reason."""
    path = f"{ensure_checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    _page_xml(Tables(spark, sf_dir).documents).write.text(path)
    return scan_dump(spark, path).select("id", "title", "redirect", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"), "problem")


_R1_PAGES = """
    select cast(p_partkey as bigint) id, 0 ns, concat('Part_', cast(p_partkey as string)) title, cast(null as string) redirect,
      coalesce(t, '') raw_text, if(p_partkey % 3 = 0, 2, 1) batch
    from {part} left join (select id, array_join(transform(array_sort(collect_list(category_id - 1000000000)),
      s -> concat('[[Category:Supplier ', cast(s as string), ']]')), ' ') t from {w_categories} group by id) c on id = p_partkey
    union all select 1300000000 + p_partkey, 1, concat('Talk:Part_', cast(p_partkey as string)), null,
      concat('{{{{WikiProject Parts|class=', quality, '|importance=', importance, '}}}}'), if(p_partkey % 2 = 0, 0, 2)
    from {part} join {w_quality} q on q.id = p_partkey join {w_importance} i on i.id = p_partkey where p_partkey % 9 <> 0
    union all select 1000000000 + s_suppkey, 14, concat('Category:Supplier_', cast(s_suppkey as string)), null, '', s_suppkey % 3
    from {supplier} where s_suppkey % 7 <> 0
    union all select 1400000000 + p_partkey, 0, concat('Alias_', cast(p_partkey as string)), concat('Part_', cast(p_partkey as string)), '', 0
    from {part} where p_partkey % 10 = 0"""


@register("r1_stream_ingest", with_views("""
    select p_partkey id, 'Part_' || p_partkey title, coalesce(c.names, 'NONE') categories,
      case when p_partkey % 9 = 0 then 'N/A' else quality end quality, case when p_partkey % 9 = 0 then 'N/A' else importance end importance
    from part join w_quality q on q.id = p_partkey join w_importance i on i.id = p_partkey
    left join (select id, string_agg('Category:Supplier_' || (category_id - 1000000000), ' | ' order by category_id) names
      from w_categories where (category_id - 1000000000) % 7 <> 0 group by id) c on c.id = p_partkey""",
          "w_quality", "w_importance", "w_categories"))
def r1_stream_ingest(spark, sf_dir):
    """Part articles ingested by a file stream of three batches: talk and category pages before and after their articles."""
    t = Tables(spark, sf_dir)
    views = {n: t.view(n) for n in ("w_categories", "w_quality", "w_importance")}
    pages = spark.sql(_R1_PAGES, part=t.part, supplier=t.supplier, **views)
    base = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ts = F.lit("2010-01-01 00:00:00").cast("timestamp")
    state = IngestState(spark, f"{base}/state", buckets=8)
    pages, drop = stored(pages, "ingest-pages", by="batch")  # made once, not once a batch
    for k in range(3):  # files arrive, the stream goes on where it ended
        pages.where(F.col("batch") == k).select("id", "ns", "title", "redirect", ts.alias("ts"), "raw_text") \
            .write.parquet(f"{base}/pages/batch{k}")
        stream = stream_ingest(spark, f"{base}/pages/*", state, f"{base}/checkpoint")
        stream.awaitTermination()
        if stream.exception():
            raise stream.exception()
    drop()
    return state.articles().select("id", "title", "categories", "quality", "importance")
