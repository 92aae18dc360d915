"""Scalar string expressions (all JVM-side, codegen'd).

Each helper takes and returns a ``Column``; none calls Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _q(s: str) -> str:
    """Quote a literal for a Java regex."""
    return re.escape(s)


def wtrim(c) -> Column:
    """Trim whitespace (spaces, tabs, newlines) at both ends."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def between(c, open_tag: str, close_tag: str) -> Column:
    """Text between the first ``open_tag`` and the nearest ``close_tag`` after it ('' if absent)."""
    return F.regexp_extract(_c(c), f"(?s){_q(open_tag)}(.*?){_q(close_tag)}", 1)


def between_all(c, open_tag: str, close_tag: str) -> Column:
    """All non-overlapping texts between ``open_tag`` and the nearest ``close_tag``."""
    return F.regexp_extract_all(_c(c), F.lit(f"(?s){_q(open_tag)}(.*?){_q(close_tag)}"), 1)


def count_string(c, tag: str) -> Column:
    """Non-overlapping occurrences of ``tag``."""
    return F.regexp_count(_c(c), F.lit(_q(tag)))


def remove_between(c, open_tag: str, close_tags, max_gap: int | None = None) -> Column:
    """Erase ``open_tag`` ... nearest of ``close_tags``, leftmost first; unmatched openings stay.

    ``max_gap`` only erases spans shorter than that many characters.
    """
    ends = [close_tags] if isinstance(close_tags, str) else list(close_tags)
    alt = "|".join(_q(e) for e in ends)
    body = f".{{0,{max_gap - 1}}}?" if max_gap else ".*?"
    return F.regexp_replace(_c(c), f"(?s){_q(open_tag)}{body}(?:{alt})", "")


def by_text(fn: Callable[[str], str]):
    """A string UDF that calls ``fn`` on every text that is not null.  Texts become Python strings
    64 at a time, so a worker holds a batch's Arrow buffers and little else."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        made = [pa.array([None if t is None else fn(t) for t in texts.slice(at, 64).to_pylist()], pa.string())
                for at in range(0, len(texts), 64)]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())
    return run


def without_pairs(text: str, target: str) -> str:
    """Fix-point of removing the two-character ``target`` from ``text``."""
    kept: list[str] = []
    for ch in text:
        if ch == target[1] and kept and kept[-1] == target[0]:
            kept.pop()
        else:
            kept.append(ch)
    return "".join(kept)


def remove_target(c, target: str) -> Column:
    """Remove every ``target``, to a fix-point (a removal cannot join a new one)."""
    if len(target) == 1:
        return F.replace(_c(c), F.lit(target), F.lit(""))
    if len(target) == 2 and target[0] != target[1]:
        # an opening/closing pair: a removal can join a new pair, as in '(())',
        # to any depth; one pass with a stack of openings, only where a pair is
        unpaired = by_text(lambda t: without_pairs(t, target))
        c = _c(c)
        has = c.contains(target)
        return F.when(has, unpaired(F.when(has, c))).otherwise(c)
    # runs of a repeated-character target vanish in one regex pass
    return F.regexp_replace(_c(c), f"(?:{_q(target)})+", "")


def squeeze(c, ch: str = " ") -> Column:
    """Replace runs of ``ch`` by one (the fix-point of replacing two by one)."""
    return F.regexp_replace(_c(c), f"(?:{_q(ch)}){{2,}}", ch)


def cap_first(c) -> Column:
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def norm_key(c, capitalize: bool = True) -> Column:
    """Page key of a title: spaces -> '_', optionally first letter upper-cased."""
    c = _c(c)
    if capitalize:
        c = cap_first(c)
    return F.replace(c, F.lit(" "), F.lit("_"))


def sanitize(c) -> Column:
    """Newlines and tabs -> space (scalars)."""
    return F.translate(_c(c), "\n\t", "  ")


def sanitize_array(c) -> Column:
    return F.transform(_c(c), lambda x: F.translate(x, "\n\t", "  "))


# The entity decoding order of the markup cleaner.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]


def decode_entities(c) -> Column:
    """Decode lt, gt, nbsp, amp, quot, apos in that order; ``&amp;amp;`` decodes fully."""
    c = _c(c)
    for ent, ch in ENTITIES:
        if ent == "&amp;":
            c = F.regexp_replace(c, "&(?:amp;)+", "&")
        else:
            c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def tokenize(c) -> Column:
    """Lower-case and split on ASCII non-word runs; empty edge tokens are kept."""
    return F.split(F.lower(_c(c)), r"\W+", -1)


def whitespace_tokens(c) -> Column:
    """Split on whitespace; a blank text gives an empty array."""
    t = wtrim(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+", -1))


def sentence_tokens(c) -> Column:
    """Sentences split on '. ', each cleaned (',' -> space, parentheses and '&nbsp;' dropped,
    spaces squeezed, lower) and split on spaces: an array of token arrays."""
    sents = F.split(_c(c), r"\. ", -1)

    def clean(s):
        s = F.replace(s, F.lit(","), F.lit(" "))
        s = F.regexp_replace(s, r"[()]|&nbsp;", "")
        s = F.lower(F.regexp_replace(s, " {2,}", " "))
        return F.split(s, " ", -1)
    return F.transform(sents, clean)


def drop_stopwords(tokens, stopwords: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(_c(tokens), lambda x: ~F.array_contains(stop, x))


def query_key(c) -> Column:
    """Word query normalization: spaces -> '_', lower-cased."""
    return F.lower(F.replace(_c(c), F.lit(" "), F.lit("_")))


def algebra_terms(c) -> Column:
    """Split ``a + b - c d`` into signed terms: array<struct<sign:int, word:string>>.

    A sign carries over to the following words until the next sign.
    """
    toks = F.regexp_extract_all(_c(c), F.lit(r"([+-]|[^+\-\s]+)"), 1)
    # sign in force at each token = last sign token at or before it (default +)
    idx = F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1)))
    signed = F.transform(
        idx,
        lambda i: F.struct(
            F.when(
                F.try_element_at(F.filter(F.slice(toks, 1, i), lambda t: t.isin("+", "-")), F.lit(-1)) == "-", -1
            ).otherwise(1).alias("sign"),
            F.try_element_at(toks, i).alias("word")))
    return F.filter(signed, lambda s: ~s["word"].isin("+", "-") & s["word"].isNotNull())


def has_junk_token(c) -> Column:
    """Words that are markup remnants: contain 'nbsp', 'ndash' or '_'."""
    return _c(c).rlike("nbsp|ndash|_")
