"""Relational queries: resolution joins, quality, categories, hierarchy, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categories as C
from ..operators import hierarchy as H
from ..operators import quality as Q
from ..operators import resolve as R
from ..operators.explore import search_rows
from ..sources.fixtures import Tables, with_views
from .registry import register

N_LARGEST = 20

_RANK_CASE = ("case lower(trim(quality)) when 'fa' then 6 when 'a' then 5 when 'ga' then 4 "
              "when 'b' then 3 when 'c' then 2 when 'start' then 1 when 'stub' then 0 end")
_LABEL_CASE = ("case cast(floor(cast(s as double) / n + 0.5) as integer) when 7 then 'Featured' "
               "when 6 then 'Featured' when 5 then 'A-Class' when 4 then 'Good' when 3 then 'B' "
               "when 2 then 'C' when 1 then 'Start' when 0 then 'Stub' end")


@register("a5_source_quality", with_views(f"""
    select id, {_LABEL_CASE} as source_quality, round(cast(s as double) / n, 6) as mean_rank, n as n_rated
    from (select l.id, sum(q.r) s, count(*) n
          from w_links l join (select id, {_RANK_CASE} r from w_quality) q on l.link_id = q.id
          where q.r is not null group by l.id) a""", "w_links", "w_quality"))
def a5_source_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.source_quality(t.w_links, t.w_quality)


@register("j3_resolve_redirects", with_views("""
    select r.title, r.target_title, t.id as target_id
    from w_redirects r join w_titles t on r.target_title = t.title""", "w_redirects", "w_titles"))
def j3_resolve_redirects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.resolve_redirects(t.w_redirects, t.w_titles)


@register("j4_resolve_links", with_views("""
    select l.id, l.pos, t.id as link_id
    from w_raw_links l left join w_redirects r on l.link = r.title
    join w_titles t on coalesce(r.target_title, l.link) = t.title""",
                                         "w_raw_links", "w_redirects", "w_titles"))
def j4_resolve_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.resolve_links(t.w_raw_links, t.w_titles, t.w_redirects)


@register("j1_resolve_titles", with_views("""
    select l.id, l.pos, l.link, t.id as link_id
    from w_raw_links l left join w_titles t on l.link = t.title""", "w_raw_links", "w_titles"))
def j1_resolve_titles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.resolve_titles(t.w_raw_links, t.w_titles, col="link", out="link_id")


@register("j2_attach_titles", with_views("""
    select l.id, l.pos, l.link_id, t.title as link_title
    from w_links l left join w_titles t on l.link_id = t.id""", "w_links", "w_titles"))
def j2_attach_titles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.attach_titles(t.w_links, t.w_titles, id_col="link_id", out="link_title")


_RAW_CATEGORIES = """
    select l_partkey id, l_linenumber pos,
           case when l_partkey % 9 = 0 then concat('Category:Missing_', cast(l_suppkey as string))
                else concat('Category:Supplier_', cast(l_suppkey as string)) end category
    from {lineitem}"""


@register("j5_resolve_categories", with_views("""
    select c.id, c.pos, t.id as category_id
    from raw_categories c join w_titles t on c.category = t.title""", "w_titles",
                                              extra={"raw_categories": _RAW_CATEGORIES.replace("{lineitem}", "lineitem")}))
def j5_resolve_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = spark.sql(_RAW_CATEGORIES, lineitem=t.lineitem)
    return R.resolve_categories(raw, t.w_titles)


@register("j6_talk_to_article", with_views("""
    select k.id as talk_id, t.id as real_id
    from w_talk_titles k join w_titles t on substring(k.title, 6) = t.title
    where k.title like 'Talk:%'""", "w_talk_titles", "w_titles"))
def j6_talk_to_article(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.talk_to_article(t.w_talk_titles, t.w_titles)


@register("j8_lookup_quality", with_views("""
    select t.id, t.title, lower(q.quality) as quality
    from w_titles t left join w_quality q on t.id = q.id""", "w_titles", "w_quality"))
def j8_lookup_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.lookup_quality(t.w_titles, t.w_quality)


@register("j9_quality_importance", with_views("""
    select q.id, q.quality, i.importance from w_quality q join w_importance i on q.id = i.id""",
                                              "w_quality", "w_importance"))
def j9_quality_importance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.quality_importance(t.w_quality, t.w_importance)


@register("j12_category_titles", with_views("""
    select c.id, string_agg(t.title, ' | ' order by c.category_id) as titles
    from w_categories c left join w_titles t on c.category_id = t.id
    group by c.id having count(*) = count(t.title)""", "w_categories", "w_titles"))
def j12_category_titles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cats = t.w_categories.withColumn("pos", F.col("category_id"))
    return R.titles_for_lists(cats, t.w_titles, out="titles")


@register("a1_category_sizes", with_views("""
    select category_id, count(*) as size from w_categories group by category_id""", "w_categories"))
def a1_category_sizes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.category_sizes(t.w_categories)


_LARGEST = f"""
    select t.title, s.category_id, s.size
    from (select category_id, count(*) size from w_categories group by category_id) s
    join w_titles t on s.category_id = t.id
    order by s.size desc, s.category_id limit {N_LARGEST}"""


@register("t1_largest_categories", with_views(_LARGEST, "w_categories", "w_titles"))
def t1_largest_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.largest_categories(t.w_categories, t.w_titles, N_LARGEST)


_ASSIGNED = """
    select id, arg_min(c.category_id, c.size * 10000000000 + c.category_id) as category_id
    from (select w.id, w.category_id, g.size from w_categories w join largest g on w.category_id = g.category_id) c
    where id in (select id from w_titles)
    group by id"""


@register("a2_assign_category", with_views(_ASSIGNED, "w_categories", "w_titles",
                                           extra={"largest": _LARGEST}))
def a2_assign_category(spark, sf_dir):
    t = Tables(spark, sf_dir)
    largest = C.largest_categories(t.w_categories, t.w_titles, N_LARGEST)
    return C.assign_category(t.w_categories, largest, t.w_titles, N_LARGEST)


@register("a3_effective_sizes", with_views("""
    select g.title, g.category_id, g.size, coalesce(e.n, 0) as effective_size
    from largest g left join (select category_id, count(*) n from assigned group by category_id) e
    on g.category_id = e.category_id""", "w_categories", "w_titles",
                                           extra={"largest": _LARGEST, "assigned": _ASSIGNED}))
def a3_effective_sizes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = C.compile_categories(t.w_categories, t.w_titles, N_LARGEST)
    return out["effective"]


@register("a6_category_children", with_views("""
    select parent_id as category_id, count(*) as n_children from w_category_parents group by parent_id""",
                                             "w_category_parents"))
def a6_category_children(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.category_children(t.w_category_parents)


@register("t8_category_pages", with_views("""
    select rank, category_id, n_items, page, list(id order by id) as items from (
      select e.category_id, id, n_items, r.rank,
        cast(floor((row_number() over (partition by e.category_id order by id) - 1) / 100) as integer) page
      from (select distinct category_id, id from w_categories) e join (
        select category_id, count(distinct id) n_items, row_number() over (order by count(distinct id) desc, category_id) - 1 as rank
        from w_categories group by category_id) r on r.category_id = e.category_id) x
    group by rank, category_id, n_items, page""", "w_categories"))
def t8_category_pages(spark, sf_dir):
    """Members of all categories in pages of 100, the largest category first."""
    return C.paged_lists(Tables(spark, sf_dir).w_categories, "category_id", "id", page_size=100)


@register("a10_list_stats", with_views("""
    select 'links' as list_name, count(distinct id) as n_keys, count(*) as n_items,
           round(count(*) / count(distinct id), 6) as mean_len from w_links
    union all
    select 'categories', count(distinct id), count(*), round(count(*) / count(distinct id), 6) from w_categories
    union all
    select 'category_parents', count(distinct child_id), count(*), round(count(*) / count(distinct child_id), 6)
    from w_category_parents""", "w_links", "w_categories", "w_category_parents"))
def a10_list_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (C.list_stats(t.w_links, "id", "links")
            .unionByName(C.list_stats(t.w_categories, "id", "categories"))
            .unionByName(C.list_stats(t.w_category_parents, "child_id", "category_parents")))


@register("a19_category_members", with_views("""
    select c.category_id, c.id, t.title from w_categories c left join w_titles t on c.id = t.id""",
                                             "w_categories", "w_titles"))
def a19_category_members(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.category_members(t.w_categories, t.w_titles)


_ANCESTORS = """
    select category_id, ancestor_id, min(depth) as depth from (
      select child_id category_id, parent_id ancestor_id, 1 depth from w_category_parents
      union all
      select a.child_id, b.parent_id, 2 from w_category_parents a join w_category_parents b on a.parent_id = b.child_id
      union all
      select a.child_id, c.parent_id, 3 from w_category_parents a join w_category_parents b on a.parent_id = b.child_id
                                       join w_category_parents c on b.parent_id = c.child_id
    ) x group by category_id, ancestor_id"""


@register("g1_ancestors", with_views(_ANCESTORS, "w_category_parents"))
def g1_ancestors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return H.ancestors(t.w_category_parents, max_depth=3)


@register("g2_deepen_categories", with_views("""
    select id, category_id, min(depth) as depth from (
      select id, category_id, 0 depth from w_categories
      union all
      select c.id, a.ancestor_id, a.depth from w_categories c join anc a on c.category_id = a.category_id
    ) x group by id, category_id""", "w_categories", "w_category_parents", extra={"anc": _ANCESTORS}))
def g2_deepen_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return H.deepen_categories(t.w_categories, H.ancestors(t.w_category_parents, max_depth=3))


@register("e1_search_rows", """
    select * from customer
    where lower(cast(c_custkey as varchar)) = 'building' or lower(c_name) = 'building'
       or lower(cast(c_nationkey as varchar)) = 'building' or lower(cast(c_acctbal as varchar)) = 'building' or lower(c_mktsegment) = 'building'""")
def e1_search_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search_rows(t.customer, "BUILDING")


@register("j7_talk_id_map", with_views("""
    select k.id as talk_id, t.id as real_id
    from alltitles k join alltitles t on substring(k.title, 6) = t.title
    where k.title like 'Talk:%'""", "w_titles", "w_talk_titles",
                                       extra={"alltitles": "select * from w_titles union all select * from w_talk_titles"}))
def j7_talk_id_map(spark, sf_dir):
    """Talk id -> article id inside one titles table holding both kinds of page."""
    t = Tables(spark, sf_dir)
    both = t.w_titles.unionByName(t.w_talk_titles)
    return R.talk_to_article(both, both)


@register("j13_category_parent_titles", with_views("""
    select p.child_id, c.title as child_title, p.parent_id, t.title as parent_title
    from w_category_parents p join w_titles c on p.child_id = c.id join w_titles t on p.parent_id = t.id""",
                                                   "w_category_parents", "w_titles"))
def j13_category_parent_titles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = R.attach_titles(t.w_category_parents, t.w_titles, id_col="child_id", out="child_title", how="inner")
    return R.attach_titles(j, t.w_titles, id_col="parent_id", out="parent_title", how="inner")


@register("u5_insert_ignore", with_views("""
    select id, title, quality from (select t.id, t.title, q.quality from w_titles t join w_quality q on t.id = q.id) x""",
                                         "w_titles", "w_quality"))
def u5_insert_ignore(spark, sf_dir):
    """Rows already present (featured articles) + every article: each id once."""
    from ..sources.sinks import insert_ignore
    t = Tables(spark, sf_dir)
    rows = t.w_titles.join(t.w_quality, "id").select("id", "title", "quality")
    present = rows.where(F.col("quality").isin("fa", "a"))
    return insert_ignore(present, rows)


@register("s20_category_report", with_views(f"""
    select 'String | ID | Article Count' as value
    union all
    select concat_ws(' | ', title, cast(category_id as varchar), cast(size as varchar)) from ({_LARGEST}) l""",
                                            "w_categories", "w_titles"))
def s20_category_report(spark, sf_dir):
    from ..sources.sinks import category_report
    t = Tables(spark, sf_dir)
    return category_report(C.largest_categories(t.w_categories, t.w_titles, N_LARGEST))


@register("e1_search_first", """
    select * from customer
    where lower(cast(c_custkey as varchar)) = 'machinery' or lower(c_name) = 'machinery'
       or lower(cast(c_nationkey as varchar)) = 'machinery' or lower(cast(c_acctbal as varchar)) = 'machinery' or lower(c_mktsegment) = 'machinery'
    order by c_custkey limit 1""")
def e1_search_first(spark, sf_dir):
    """The first matching row (smallest key), as the table search returns it."""
    t = Tables(spark, sf_dir)
    return search_rows(t.customer, "Machinery", first_only=True, order_by="c_custkey")
