"""URL filter: rules first, then naive Bayes over segmented hosts and path tokens.

A rule (verdict, host, path) fits its host and all subdomains of it where the
url's path starts with the rule's path; the longest fitting rule decides.
Every other url is judged by multinomial naive Bayes, learned from the urls
that rules decide.  Its tokens are the words of the host -- its letter runs are
split by Viterbi under a unigram model of the words in the pages' text -- and
the tokens of the path.

Hosts are split once each, from the counts of their own substrings only, and
urls are scored once per distinct host and path; neither the word counts nor
the token weights are ever sent to every task.

A null url, or one without ``://``, has an empty host and path and is judged by
the class sizes alone; equal scores allow.  Without text every letter run stays
whole, without decided urls all others are allowed.  Repeated rows each get
their row; columns that clash with the result's are not carried over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_WORD = 20
WEIGHT = "decimal(38,12)"  # sums of weights do not depend on their order

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(texts: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of all words of at most ``MAX_WORD`` letters in the text outside tags."""
    text = F.lower(F.regexp_replace(F.coalesce(html_col, F.lit("")), "<[^>]*>", " "))
    return (texts.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
            .where((F.col("word") != "") & (F.length("word") <= MAX_WORD)).groupBy("word").agg(F.count("*").alias("n")))


def best_split(run: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable words of a letter run; an unknown word costs ten times more per letter."""
    best = [(0.0, 0)]
    log_total = math.log(total)
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get(run[start:end])
            cost = log_total - math.log(n) if n else log_total + (end - start) * math.log(10.0)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(run)
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return words[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``hosts(host)`` (distinct) -> (host, words)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] or 1
    runs = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "run")).where("run <> ''")
    # the substrings of a run are at most its length times MAX_WORD
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.length("run") - i + 1, F.lit(MAX_WORD))), lambda k: F.substring(F.col("run"), i, k))))
    parts = runs.select("run").distinct().select("run", F.explode(F.array_distinct(cut)).alias("word"))
    known = parts.join(counts, "word").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.udf("array<string>")  # once per distinct run
    def split(run, known):
        return best_split(run, known or {}, total)

    words = (runs.select("run").distinct().join(known, "run", "left").select("run", split("run", "known").alias("words")))
    by_host = (runs.join(words, "run").groupBy("host")
               .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words")))
    return hosts.join(by_host, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score); score is the log odds of blocking, null where a rule decides."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("_fit", fit)
    places = parts.groupBy("host", "path").agg(F.count("*").alias("n"))
    words = segmented(places.select("host").distinct(), stage(word_counts(pages, html_col), "word-counts"))
    path_tokens = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = (places.join(words, "host")
              .withColumn("tokens", F.concat(F.transform("words", lambda w: F.concat(F.lit("host "), w)),
                                             F.transform(path_tokens, lambda t: F.concat(F.lit("path "), t))))
              .withColumn("decided", fit["verdict"]).select("host", "path", "n", "tokens", "decided"))
    blocked = lambda n: F.sum(F.when(F.col("decided") == "block", n).otherwise(0))
    allowed = lambda n: F.sum(F.when(F.col("decided") == "allow", n).otherwise(0))
    taught = tokens.where("decided is not null")
    counts = (taught.select("decided", "n", F.explode("tokens").alias("token")).groupBy("token")
              .agg(blocked(F.col("n")).alias("block"), allowed(F.col("n")).alias("allow")))
    sums = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"),
                      F.count("*").alias("v")).first()
    prior = taught.agg(F.coalesce(blocked(F.col("n")), F.lit(0)).alias("block"), F.coalesce(allowed(F.col("n")), F.lit(0)).alias("allow")).first()
    norm = math.log((sums["allow"] + sums["v"] + 1) / (sums["block"] + sums["v"] + 1))
    weights = counts.select("token", (F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0)).cast(WEIGHT).alias("w"))
    open_ = tokens.where("decided is null").select("host", "path", "tokens")
    seen = (open_.select("host", "path", F.explode("tokens").alias("token")).join(weights, "token")
            .groupBy("host", "path").agg(F.sum("w").alias("w")))
    start = math.log((prior["block"] + 1) / (prior["allow"] + 1))
    score = (F.lit(start) + F.col("n_tokens") * F.lit(norm) + F.coalesce(F.col("w").cast("double"), F.lit(0.0)))
    scored = (open_.select("host", "path", F.size("tokens").alias("n_tokens")).join(seen, ["host", "path"], "left")
              .select("host", "path", score.alias("score")))
    return (parts.join(scored, ["host", "path"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("_fit.rule").alias("rule"),
                    F.coalesce("_fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score"))
