"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import (bpe, decontaminate, embedding, htmltext, langid, merkle, ngram, passages, repeats, simhash, urls,
               vectorcodes, warc)
from .common import map_batches, stage, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark, sf_dir):
    """All documents against all benchmark items."""
    marked = decontaminate.verdict(decontaminate.mark(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                         F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontaminate"] = f"""
with d as (select row_number() over () rid, doc_id, coalesce({_WORDS.format('text')}, []) w from documents),
i as (select item_id, {_WORDS.format('text')} w from benchmark where text is not null),
win as (select distinct item_id, least(13, len(w)) m, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') g
        from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) s from i where len(w) > 0) x),
ms as (select distinct m from win),
g as (select rid, m, s, array_to_string(w[s:s + m - 1], ' ') g
      from (select rid, w, m, unnest(range(1, len(w) - m + 2)) s from d, ms where len(w) >= m) x),
hit as (select rid, s, g.m, item_id from g join win using (m, g)),
pos as (select rid, count(distinct p) n_hit from (select rid, unnest(range(s, s + m)) p from hit) x group by rid),
it as (select rid, count(distinct item_id) n_items,
       string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hit group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (rid) left join it using (rid)"""


@query
def op7_simhash(spark, sf_dir):
    """Classes of all documents at four or fewer differing bits."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_ranks(path: str | None = None) -> dict[bytes, int]:
    """Ranks of the vocabulary file (default: the public byte-level one of 50k pieces)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.load_ranks(path)


def encoded_digests(coded, ranks, keep: list[str]):
    """The kept columns of encoded documents, with the number and digest of their ids
    and the digest of the bytes decoded from them."""
    pieces = coded.sparkSession.sparkContext.broadcast(bpe.piece_table(ranks))  # one entry per piece of the vocabulary

    def digest(batch):
        ids = batch.column(batch.schema.get_field_index("ids"))
        values, off = ids.values.to_numpy(), ids.offsets.to_numpy()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {"n_tokens": np.diff(off).astype(np.int64),
                "ids_sha256": [sha(values[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())],
                "decoded_sha256": [sha(x) for x in bpe.decoded(ids, pieces.value)]}

    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                         T.StructField("decoded_sha256", T.StringType())])
    return map_batches(coded, digest, made, keep=keep)


@query
def op9_bpe(spark, sf_dir):
    """Ids of all documents, and their bytes decoded from the ids again."""
    ranks = tokenizer_ranks()
    return encoded_digests(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks, keep=["doc_id"])


@query
def op4_langid(spark, sf_dir):
    """Language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.where(third != 1))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_passages(spark, sf_dir):
    """Passages of all documents that an earlier document has."""
    docs = table(spark, sf_dir, "documents")
    found = passages.spans_by_document(passages.duplicate_spans(docs))
    rows = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("_h"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long").alias("n_words"))
    spans = F.coalesce("spans", F.array().cast("array<int>"))
    n_dup = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    return (rows.join(found, (rows["doc_id"] == found["id"]) & (rows["_h"] == found["h"]), "left")
            .select("doc_id", "n_words", n_dup.alias("n_duplicate"), (F.size(spans) / 2).cast("long").alias("n_spans"),
                    spans.alias("spans"), F.coalesce("originals", F.array().cast("array<long>")).alias("originals")))


@query
def op3_embedding(spark, sf_dir):
    """All vectors at a cosine of 0.9 or more."""
    return embedding.links(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op10_urls(spark, sf_dir):
    """Verdicts on the urls of all pages."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op6_warc(spark, sf_dir):
    """Metadata and conversion records of all pages."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return made.select(
        F.col("id").alias("page_id"), "record_id", "type", h["WARC-Refers-To"].alias("refers_to"),
        h["WARC-Target-URI"].alias("target_uri"), h["WARC-Source-Payload-Digest"].alias("source_digest"),
        h["WARC-Block-Digest"].alias("block_digest"), h["Content-Length"].cast("long").alias("content_length"),
        F.when(F.col("type") == "conversion", F.decode("block", "UTF-8")).alias("text"),
        F.when(F.col("type") == "metadata", F.get_json_object(F.decode("block", "UTF-8"), "$.title")).alias("title"))


@query
def op2_ngram(spark, sf_dir):
    """Log probabilities of all documents, learned from nine tenths of them."""
    tenth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (tenth != 0).alias("train"))
    return ngram.score(docs).select(
        F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_repeats(spark, sf_dir):
    """All documents without the bytes of strings of 400 bytes that start twice."""
    return repeats.removed(table(spark, sf_dir, "documents"))


def _uuid(kind: str, name: str) -> str:
    h = f"md5('{kind}|' || {name})"
    cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


def _sql_decoded(text: str) -> str:
    for entity, character in warc.ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, character.replace("'", "''"))
    return text


_SQL_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '{}', ' ', 'g'), '{}', chr(10), 'g'), '{}', '', 'g')".format(
    warc.HIDDEN, warc.BREAKS, warc.TAGS)
_SQL_TEXT = (r"regexp_replace(regexp_replace(regexp_replace(" + _sql_decoded(_SQL_TEXT)
             + r", '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')")

ORACLES["op6_warc"] = f"""
with p as (select page_id, coalesce(url, '') url, coalesce(html, '') html, sha256(coalesce(html, '')) payload,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) as head from pages),
s as (select *, {_uuid('response', "concat_ws('|', cast(page_id as varchar), url, payload)")} source_id,
  sha256(head || chr(13) || chr(10) || chr(13) || chr(10) || html) whole,
  trim({_sql_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) title, {_SQL_TEXT} as plain,
  regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) links from p),
m as (select *, cast(to_json({{'title': title, 'links': links, 'http_headers': head, 'source': {{'record_id': source_id,
  'payload_digest': 'sha256:' || payload, 'block_digest': 'sha256:' || whole,
  'content_length': cast(strlen(head) + 4 + strlen(html) as varchar)}}}}) as varchar) meta from s)
select page_id, {_uuid('metadata', 'source_id')} record_id, 'metadata' as type, source_id refers_to, url target_uri,
  'sha256:' || payload source_digest, 'sha256:' || sha256(meta) block_digest, cast(strlen(meta) as bigint) content_length,
  cast(null as varchar) as text, title from m
union all
select page_id, {_uuid('conversion', 'source_id')}, 'conversion', source_id, url, 'sha256:' || payload,
  'sha256:' || sha256(plain), cast(strlen(plain) as bigint), plain, null from m"""


@query
def op11_merkle(spark, sf_dir):
    """Proofs of all documents against the manifest's root, half of them with a changed text."""
    def leaf(text):
        parts = [merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
        return merkle.digest_of(*parts, merkle.field(text))

    text = F.col("text")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & text.contains("\n"), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    tiers, top = merkle.manifest(table(spark, sf_dir, "documents"), leaf(text), F.col("source"), F.col("doc_id"),
                                 keep=["doc_id"], other=changed)
    return merkle.check(tiers, top)


def _sql_field(col: str) -> str:
    text = f"cast({col} as varchar)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _sql_tree(name: str, leaves: str) -> str:
    """Levels of trees over ``leaves`` (g, i, h): ``name``, and ``name``_sib with what stands beside each node."""
    return f"""{name} as (
  select g, 0 lv, i, h, count(*) over (partition by g) n from {leaves}
  union all
  select g, lv + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from {name} where n > 1 group by g, lv, i // 3, n),
{name}_sib as (select g, lv, i, coalesce(string_agg(h, '' order by i) over (w rows between unbounded preceding and 1 preceding), '') a,
  coalesce(string_agg(h, '' order by i) over (w rows between 1 following and unbounded following), '') z
  from {name} where n > 1 window w as (partition by g, lv, i // 3 order by i))"""


# CRC-32 of the decimal digits, from the table of its bytes
_SQL_CRC = """crc as (select list(list_reduce([b] || [cast(0 as bigint) for x in range(8)],
  lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) order by b) bytes from (select unnest(range(256)) b)),
docs as (select *, xor(4294967295, list_reduce([4294967295] || [cast(ascii(x) as bigint) for x in string_split(cast(doc_id as varchar), '')],
  lambda c, x: xor(bytes[(xor(c, x) & 255) + 1], c >> 8))) % 2 = 0 even from documents, crc)"""

ORACLES["op11_merkle"] = f"""
with recursive {_SQL_CRC},
d as (select row_number() over () rid, doc_id, coalesce('s' || source, 'n') g, source, {_sql_leaf('text')} leaf,
  {_sql_leaf("case when even then replace(text, chr(10), '') else text end")} other from docs),
leaves as (select rid, g, source, leaf h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i from d),
{_sql_tree('t', 'leaves')},
subs as (select 0 g, row_number() over (order by s.source nulls first) - 1 i, t.h, t.g of_group
  from t join (select distinct g, source from d) s using (g) where t.n = 1),
{_sql_tree('u', 'subs')},
f as (select rid, 0 lv, l.g, l.i, other h, '' proof from leaves l join d using (rid)
  union all select f.rid, f.lv + 1, f.g, f.i // 3, sha256(s.a || f.h || s.z), f.proof || s.a || s.z
  from f join t_sib s on s.g = f.g and s.lv = f.lv and s.i = f.i),
ft as (select rid, g, h, proof from f qualify row_number() over (partition by rid order by lv desc) = 1),
k as (select rid, 0 lv, subs.i, ft.h, proof from ft join subs on subs.of_group = ft.g
  union all select k.rid, k.lv + 1, k.i // 3, sha256(s.a || k.h || s.z), k.proof || s.a || s.z
  from k join u_sib s on s.lv = k.lv and s.i = k.i),
kt as (select rid, h, proof from k qualify row_number() over (partition by rid order by lv desc) = 1)
select doc_id, leaf, subs.h subroot, u.h root, sha256(proof) proof_sha256, kt.h folded_root, kt.h = u.h verified
from d join kt using (rid) join subs on subs.of_group = d.g, u where u.n = 1"""


@query
def op12_html(spark, sf_dir):
    """Main text of all pages."""
    return htmltext.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


# The pages of the tables have one article element each; the SQL takes it by its tags.
ORACLES["op12_html"] = r"""
with a as (select page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1) x from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(x, '</?(p|h[1-6]|ul|li|div)(\s[^>]*)?>', chr(1), 'g'),
  '<[^>]*>', ' ', 'g'), chr(1)) parts from a),
c as (select page_id, url, list_filter(list_transform(parts, lambda y: trim(regexp_replace(replace(replace(replace(replace(replace(y,
  '&quot;', '"'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda y: y <> '') blocks from b)
select page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') as text,
  cast(length(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) as bigint) n_chars from c"""


@query
def op13_codes(spark, sf_dir):
    """Codes of all usable vectors, with the error of each and of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vectorcodes.train(vectors)
    coded = stage(vectorcodes.encode(vectors, books, keep=["vec_id", "label"]), "codes")
    return (vectorcodes.with_group_sum(coded, "label", "error", "label_error")
            .select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.codebooks_digest(books)).alias("codebooks_sha256")))


def _sql_assign(out: str, books: str) -> str:
    return f"""{out} as (select rid, part, y, b.d d, b.e e from (select rid, part, y,
  min({{'d': cast(list_sum([(y[i] - c[i]) * (y[i] - c[i]) for i in range(1, len(y) + 1)]) as bigint), 'e': e}}) b
  from p join {books} using (part) group by rid, part, y))"""


def _sql_round(out: str, assigned: str, old: str) -> str:
    return f"""{out}_n as (select part, e, list(m order by i) c from (select part, e, i, cast(floor(sum(y[i]) / count(*)) as bigint) m
  from {assigned}, (select unnest(range(1, 1 + (select max(len(y)) from p))) i) group by part, e, i) group by part, e),
{out} as (select part, e, coalesce(n.c, o.c) c from {old} o left join {out}_n n using (part, e))"""


ORACLES["op13_codes"] = f"""
with v as (select row_number() over () rid, vec_id, label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] q
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select rid, part, list_slice(q, part * (len(q) // 16) + 1, (part + 1) * (len(q) // 16)) y
  from v, (select unnest(range(16)) part)),
s as (select rid, row_number() over (order by vec_id nulls last, q) - 1 e from v),
b0 as (select part, e, y c from p join s using (rid) where e < 64),
{_sql_assign('a0', 'b0')},
{_sql_round('b1', 'a0', 'b0')},
{_sql_assign('a1', 'b1')},
{_sql_round('b2', 'a1', 'b1')},
{_sql_assign('a2', 'b2')},
r as (select rid, string_agg(printf('%02x', e), '' order by part) code, cast(sum(d) as bigint) as error from a2 group by rid)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from b2) codebooks_sha256
from v join r using (rid)"""
