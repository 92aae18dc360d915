"""Labelled-data, class statistics, batching, tag matching and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import corpus as K
from ..operators import embeddings as E
from ..operators import learn as L
from ..operators import textpipe as TP
from ..operators import topics as TM
from ..operators.epochs import train_epochs
from ..operators import vectors as VO
from ..operators.tagmatch import tag_match
from ..session import reliable_checkpoint
from ..sources.fixtures import Tables, with_views
from ..sources.taxonomy import parse_taxonomy_lines
from .q_corpus import _DICT, _TOK
from .registry import register

# The class taxonomy used to tag part titles (block grammar
# ``name`` / ``=`` / tag lines / ``]``), in class order.
PART_TAXONOMY = """
/* classes of part names */
hardware
=
widget / bolt & gear
gizmo
rod
ring & plate
anvil
]
colour
=
red
blue
]
size
=
small & large
]
temperature
=
hot
cold
]
age
=
old
new
]
"""

_QUALITY_CASE = ("case lower(quality) when 'fa' then 0 when 'a' then 0 when 'ga' then 0 when 'bplus' then 0 "
                 "when 'b' then 1 when 'c' then 2 when 'stub' then 2 end")
_IMPORTANCE_CASE = ("case lower(importance) when 'top' then 0 when 'high' then 1 when 'mid' then 2 "
                    "when 'low' then 3 end")


def _labelled(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return L.labelled(t.documents.select("doc_id", "text", "lang", "n_chars"), t.labels, "doc_id")


@register("j10_labelled_text", """
    select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id""")
def j10_labelled_text(spark, sf_dir):
    return _labelled(spark, sf_dir).drop("text")


# category -> class: suppliers of region 0 give class 0, every seventh
# supplier of region 1 gives class 1, all other categories are unmapped
_CAT_REGION = """
    select 1000000000 + s.s_suppkey category_id,
           case when n.n_regionkey = 0 then 0 when n.n_regionkey = 1 and s.s_suppkey % 7 = 0 then 1 end label
    from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey"""


@register("a7_unanimous_label", with_views("""
    select c.id, min(r.label) as label
    from w_categories c join cat_region r on c.category_id = r.category_id
    group by c.id having min(r.label) = max(r.label)""", "w_categories",
                                           extra={"cat_region": _CAT_REGION.replace("{supplier}", "supplier")
                                                  .replace("{nation}", "nation")}))
def a7_unanimous_label(spark, sf_dir):
    t = Tables(spark, sf_dir)
    region = spark.sql(_CAT_REGION, supplier=t.supplier, nation=t.nation)
    assign = t.w_categories.join(region, "category_id", "left").select("id", "label")
    return L.unanimous_label(assign)


@register("a8_class_counts", "select quality as label, count(*) as n from labels group by quality")
def a8_class_counts(spark, sf_dir):
    return L.class_counts(Tables(spark, sf_dir).labels.withColumnRenamed("quality", "label"))


@register("a9_class_lengths", r"""
    select l.quality as label, round(avg(len(string_split_regex(lower(d.text), '\W+'))), 6) as mean_len
    from documents d join labels l on d.doc_id = l.doc_id group by l.quality""")
def a9_class_lengths(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    tok = lab.select(F.col("quality").alias("label"), tokenize("text").alias("tokens"))
    return L.class_lengths(tok)


@register("a11_class_weights", """
    select quality as label, n, round(max(n) over () / n, 6) as weight
    from (select quality, count(*) n from labels group by quality) c""")
def a11_class_weights(spark, sf_dir):
    return L.class_weights(Tables(spark, sf_dir).labels.withColumnRenamed("quality", "label"))


@register("t3_cap_per_class", """
    select doc_id, quality as label, toxic from (
      select *, row_number() over (partition by quality order by doc_id) rn from labels) x where rn <= 50""")
def t3_cap_per_class(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels.withColumnRenamed("quality", "label")
    return L.cap_per_class(lab, 50, order_col="doc_id")


@register("t4_class_batches", """
    select doc_id, quality as label, toxic, rn - 1 as pos_in_class, cast(floor((rn - 1) / 50) as bigint) as batch
    from (select *, row_number() over (partition by quality order by doc_id) rn from labels) x""")
def t4_class_batches(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels.withColumnRenamed("quality", "label")
    return L.class_batches(lab, 50, order_col="doc_id")


@register("t6_train_test_split")
def t6_train_test_split(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    train, test = L.split_train_test(emb, "vec_id", 0.8)
    return (train.select("vec_id", F.lit("train").alias("part"))
            .unionByName(test.select("vec_id", F.lit("test").alias("part"))))


@register("t7_vocab_band", with_views(f"""
    select word_id, word, doc_freq from ({_DICT}) d where doc_freq between 10 and 300""",
                                      "w_text", extra={"tok": _TOK}))
def t7_vocab_band(spark, sf_dir):
    tok = K.tokens(Tables(spark, sf_dir).w_text)
    return L.vocab_band(K.build_dictionary(tok), 10, 300)


@register("m3_label_map", with_views(f"""
    select q.id, {_QUALITY_CASE} as quality_class, {_IMPORTANCE_CASE} as importance_class
    from w_quality q join w_importance i on q.id = i.id""", "w_quality", "w_importance"))
def m3_label_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    qi = t.w_quality.join(t.w_importance, "id")
    return qi.select("id", L.label_map("quality", L.QUALITY_CLASSES).alias("quality_class"),
                     L.label_map("importance", L.IMPORTANCE_CLASSES).alias("importance_class"))


@register("m4_one_hot", """
    select vec_id, list_transform(range(0, 10), lambda i: cast(i = label as integer)) as one_hot from embeddings""")
def m4_one_hot(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    return emb.select("vec_id", L.one_hot(F.col("label"), 10).alias("one_hot"))


@register("m1_sequence_dataset", with_views(f"""
    select id, list_resize(l[1:120], 120, cast(0 as bigint)) as seq from (
      select ex.id, list(coalesce(d.word_id + 1, 0) order by ex.pos) l
      from (select id, unnest(tokens) word, generate_subscripts(tokens, 1) pos from tok) ex
      left join ({_DICT}) d on ex.word = d.word
      group by ex.id) s""", "w_text", extra={"tok": _TOK}))
def m1_sequence_dataset(spark, sf_dir):
    tok = K.tokens(Tables(spark, sf_dir).w_text)
    return L.sequence_dataset(tok, K.build_dictionary(tok), max_words=120)


_CENTROID = """WITH e AS (select vec_id, cast(embedding as double[]) v,
        sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) n, label from embeddings),
    m AS (select label, list(x order by i) v from (select label, i, avg(x) x from
          (select label, unnest(cast(embedding as double[])) x, generate_subscripts(embedding, 1) i from embeddings) u
          group by label, i) g group by label),
    mn AS (select label, v, sqrt(list_dot_product(v, v)) n from m),
    s AS (select e.vec_id, e.label, mn.label cls, round(list_dot_product(e.v, mn.v) / (e.n * mn.n), 6) cosine
          from e join mn on true),
    pred AS (select vec_id, label, cls as prediction from (
          select *, row_number() over (partition by vec_id order by cosine desc, cls) rn from s) x where rn = 1)
"""


def _centroid_pred(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    dist = VO.category_distribution(emb, VO.class_vectors(emb))
    pred = (dist.groupBy("qid")
            .agg(F.min_by("label", F.struct(-F.col("cosine"), F.col("label"))).alias("prediction")))
    return emb.select(F.col("vec_id").alias("qid"), "label").join(pred, "qid").withColumnRenamed("qid", "vec_id")


@register("a15_confusion_matrix", _CENTROID + """
    select label, prediction, count(*) as n,
           round(count(*) / sum(count(*)) over (partition by label), 6) as row_fraction
    from pred group by label, prediction""")
def a15_confusion_matrix(spark, sf_dir):
    return L.confusion_matrix(_centroid_pred(spark, sf_dir))


@register("a16_accuracy", _CENTROID + """
    select a.n, a.accuracy, f.n_folds, f.mean_accuracy, f.two_std from
      (select count(*) as n, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from pred) a,
      (select count(*) as n_folds, round(avg(acc), 6) as mean_accuracy, round(2 * stddev_pop(acc), 6) as two_std
       from (select vec_id % 5 fold, avg(case when label = prediction then 1.0 else 0.0 end) acc
             from pred group by vec_id % 5) x) f""")
def a16_accuracy(spark, sf_dir):
    p = _centroid_pred(spark, sf_dir)
    return L.accuracy_with_folds(p.withColumn("fold", F.pmod("vec_id", F.lit(5))))


@register("a18_argmax_label", _CENTROID + """
    select vec_id, case when max(cosine) > 0 then arg_min(cls, cls) filter (where cosine = mx) else -1 end as pred_class
    from (select *, max(cosine) over (partition by vec_id) mx from s) z group by vec_id""")
def a18_argmax_label(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    dist = VO.category_distribution(emb, VO.class_vectors(emb))
    # class scores in class order, then the arg-max expression
    probs = (dist.groupBy(F.col("qid").alias("vec_id"))
             .agg(F.array_sort(F.collect_list(F.struct("label", "cosine"))).alias("p")))
    return probs.select("vec_id", L.argmax_label(F.col("p.cosine")).alias("pred_class"))


@register("j15_tag_match", """
    WITH tags AS (select * from (values {tags}) t(class_idx, class_name, tag)),
    titles AS (select p_partkey as id, replace(p_name, ' ', '_') as title from part),
    m AS (select t.id, t.title, g.class_idx, g.class_name from titles t join tags g
          on regexp_matches(t.title, '(^|_)' || g.tag || '(_|s|$)'))
    select id, title, min(class_idx) as class_idx, arg_min(class_name, class_idx) as class_name
    from m group by id, title""".replace("{tags}", ", ".join(
    f"({i}, '{c}', '{t}')" for i, c, t in parse_taxonomy_lines(PART_TAXONOMY))))
def j15_tag_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    titles = t.part.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("title"))
    tags = spark.createDataFrame(parse_taxonomy_lines(PART_TAXONOMY), "class_idx int, class_name string, tag string")
    return tag_match(titles, tags).select("id", "title", "class_idx", "class_name")


def _split_features(spark, sf_dir):
    emb = L.features(Tables(spark, sf_dir).embeddings).withColumn("label", F.col("label").cast("double"))
    return L.split_train_test(emb, "vec_id", 0.8)


@register("m5_logistic")
def m5_logistic(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    return L.predict(L.train_classifier(train, "logistic"), test, "vec_id")


@register("m5_one_vs_rest")
def m5_one_vs_rest(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    return L.predict(L.train_classifier(train, "ovr", max_iter=20), test, "vec_id")


@register("m7_mlp")
def m7_mlp(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    return L.predict(L.train_classifier(train, "doc_mlp", n_classes=10, max_iter=50), test, "vec_id")


@register("m6_stacked")
def m6_stacked(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    return L.predict(L.train_classifier(train, "stacked", n_classes=10, max_iter=20), test, "vec_id")


@register("m10_cross_validate")
def m10_cross_validate(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    cv = L.cross_validate(train, folds=5)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(cv.avgMetrics)], "grid int, accuracy double")


@register("m11_score_documents")
def m11_score_documents(spark, sf_dir):
    """Word2Vec document vectors -> logistic quality model on labelled docs -> scores for every document."""
    t = Tables(spark, sf_dir)
    tok = K.tokens(t.w_text)
    w2v = L.train_embeddings(tok, vector_size=32, window=5, min_count=3, max_iter=1)
    dv = L.doc_vectors(w2v, tok)
    lab = dv.join(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")), "id")
    lab = reliable_checkpoint(lab)  # the model reads it more than once
    model = L.train_classifier(L.features(lab, "vec"), "logistic", max_iter=20)
    return L.score_documents(model, L.features(dv, "vec"))


@register("v1_word2vec")
def v1_word2vec(spark, sf_dir):
    """Word vectors of all words that occur three times, trained with their parameters in blocks."""
    tok = K.stored_tokens(Tables(spark, sf_dir).w_text, row_col="row")
    return E.train(tok, size=32, window=8, min_count=3, sample=1e-5, epochs=1, row_col="row")


@register("m14_topics")
def m14_topics(spark, sf_dir):
    tok = K.tokens(Tables(spark, sf_dir).w_text)
    lda, vocab = L.topics(tok, k=5, max_iter=5)
    return lda.describeTopics(10)


@register("m14_topic_sampler")
def m14_topic_sampler(spark, sf_dir):
    """The ten most probable words of five topics, sampled over the whole vocabulary without it on the driver."""
    tok = K.stored_tokens(Tables(spark, sf_dir).w_text, row_col="row")
    return TM.fit(tok, k=5, rounds=10, row_col="row").describe(10)


@register("m12_score_words")
def m12_score_words(spark, sf_dir):
    """Quality model on document vectors applied to the word vectors of the
    words in the frequency band without markup remnants; p > 0.6 kept."""
    from ..functions.text import has_junk_token
    t = Tables(spark, sf_dir)
    tok = K.tokens(t.w_text)
    w2v = L.train_embeddings(tok, vector_size=32, window=5, min_count=3, max_iter=1)
    dv = L.doc_vectors(w2v, tok)
    lab = dv.join(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")), "id")
    lab = reliable_checkpoint(lab)  # the model reads it more than once
    model = L.train_classifier(L.features(lab, "vec"), "logistic", max_iter=20)
    band = L.vocab_band(K.build_dictionary(tok), 10, 300).where(~has_junk_token(F.col("word")))
    return L.score_words(model, L.features(L.word_vectors(w2v, band), "vec"), min_prob=0.6, id_col="word")


@register("m9_training_log")
def m9_training_log(spark, sf_dir):
    """Loss per iteration of the logistic model on the training split of the vectors."""
    train, _ = _split_features(spark, sf_dir)
    return L.training_log(L.train_classifier(train, "logistic", max_iter=30))


@register("m9_epoch_log")
def m9_epoch_log(spark, sf_dir):
    """Metrics by epoch and iteration of a network trained on the vectors until its validation loss rises."""
    train, val = _split_features(spark, sf_dir)
    return train_epochs(train, val, "doc_mlp", epochs=4, iterations=5, n_classes=10).log


@register("m8_quality_task")
def m8_quality_task(spark, sf_dir):
    """The quality of all labelled documents from their text: the confusion matrix of the held-out fifth."""
    t = Tables(spark, sf_dir)
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")).where("label is not null")
    return TP.run_task(t.w_text, labels, 2, size=32, window=5, sample=1e-4, max_iter=20)["confusion"]
