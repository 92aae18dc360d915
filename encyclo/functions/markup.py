"""Wiki markup -> columns: categories, links, citations, domains, authors,
quality, importance and the cleaned article text.

Everything is a native column expression except balanced (nested) removal of
templates and file/image links, which no regular expression can express; that
one step is an Arrow-batched ``pandas_udf`` whose per-text work is a single
``re.finditer`` over the brackets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (_c, between_all, by_text, cap_first, decode_entities, remove_between, remove_target,
                   wtrim)

# ---------------------------------------------------------------- categories


def extract_categories(c) -> Column:
    """Category keys of an article, in page order (upper-case spelling first).

    A category text with a newline keeps the part before it; when the part
    after it contains another ``Category:``, the text after that is added at
    the end.  Cut at ``|``, first letter upper-cased, ``Category:`` prefix,
    spaces -> ``_``.
    """
    raw = F.concat(between_all(c, "[[Category:", "]]"), between_all(c, "[[category:", "]]"))
    first = F.transform(raw, lambda x: F.substring_index(x, "\n", 1))
    rest = F.transform(
        F.filter(raw, lambda x: F.instr(x, "\n") > 0),
        lambda x: F.regexp_extract(x, r"(?s)\n.*?Category:(.*)$", 1))
    extra = F.filter(rest, lambda x: x != "")
    names = F.transform(F.concat(first, extra), lambda x: F.substring_index(x, "|", 1))
    return F.transform(names, lambda x: F.replace(F.concat(F.lit("Category:"), cap_first(x)),
                                                  F.lit(" "), F.lit("_")))


# --------------------------------------------------------------------- links


def extract_links(c) -> Column:
    """Link keys in page order, duplicates kept: every ``[[...]]`` that is not a
    category (either spelling) or file link, text before the first ``|``,
    trimmed, first letter upper-cased, spaces -> ``_``."""
    raw = between_all(c, "[[", "]]")
    kept = F.filter(raw, lambda x: ~(x.contains("Category:") | x.contains("category:") | x.contains("File:")))
    keys = F.transform(kept, lambda x: F.replace(cap_first(wtrim(F.substring_index(x, "|", 1))),
                                                 F.lit(" "), F.lit("_")))
    return F.filter(keys, lambda x: x != "")


# ----------------------------------------------------------------- citations


def extract_citations(c) -> Column:
    """Bodies of ``{{cite ...}}`` then ``{{Citation ...}}`` templates (up to the nearest ``}}``)."""
    return F.concat(between_all(c, "{{cite", "}}"), between_all(c, "{{Citation", "}}"))


def _field(c: Column, key: str) -> Column:
    """Value of the first ``key`` ... ``=`` in a citation body, up to ``|`` or the end."""
    return F.regexp_extract(c, rf"(?s){key}.*?=(.*?)(?:\||\}}\}}|\z)", 1)


def domain_of(c) -> Column:
    """Host part of a URL: trimmed, scheme through ``://`` dropped, cut at the first ``/``."""
    d = wtrim(c)
    d = F.regexp_replace(d, r"(?s)^.*?://", "")
    return F.substring_index(d, "/", 1)


def extract_domains(citations) -> Column:
    """Distinct non-empty cited domains in first-seen order."""
    doms = F.transform(_c(citations), lambda x: F.when(x.contains("url"), domain_of(_field(x, "url")))
                       .otherwise(F.lit("")))
    return F.array_distinct(F.filter(doms, lambda d: d != ""))


def parse_author(c) -> Column:
    """Normalize one author string: decode entities; keep the first author (cut at ``&``,
    ``;`` or the word ``and``); drop through ``By ``; ``last, first`` -> ``first last``; trim."""
    a = decode_entities(c)
    a = F.substring_index(a, "&", 1)
    a = F.substring_index(a, ";", 1)
    a = F.regexp_replace(a, r"(?s)\sand(\s.*|$)", "")
    a = F.regexp_replace(a, r"(?s)^.*?By ", "")
    a = F.when(F.instr(a, ",") > 0,
               F.concat(wtrim(F.regexp_extract(a, r"(?s)^[^,]*,(.*)$", 1)), F.lit(" "),
                        wtrim(F.substring_index(a, ",", 1)))).otherwise(a)
    return wtrim(a)


def extract_authors(citations) -> Column:
    """Distinct cited authors: ``author`` field, else ``first`` + ``last``; spaces -> ``_``."""
    def one(x):
        named = _field(x, "author")
        fl = F.concat(wtrim(F.when(x.contains("first"), _field(x, "first")).otherwise(F.lit(""))), F.lit(" "),
                      wtrim(F.when(x.contains("last"), _field(x, "last")).otherwise(F.lit(""))))
        return parse_author(F.when(x.contains("author"), named).otherwise(fl))
    names = F.filter(F.transform(_c(citations), one), lambda a: a != "")
    return F.array_distinct(F.transform(names, lambda a: F.replace(a, F.lit(" "), F.lit("_"))))


# ------------------------------------------------------------ talk pages

# Quality classes and importance levels of talk-page ratings.
QUALITY_LIST = ["fa", "a", "ga", "bplus", "b", "c", "start", "stub", "fl", "list"]
IMPORTANCE_LIST = ["low", "mid", "high", "top"]


def clean_talk(c) -> Column:
    """Talk-page pre-clean: decode entities, drop ``<!-- -->`` comments."""
    return remove_between(decode_entities(c), "<!--", "-->")


def extract_quality(talk) -> Column:
    """After the first ``WikiProject``, the first ``class = value``; lower-cased, 'unknown' when not a known class."""
    v = F.lower(wtrim(F.regexp_extract(_c(talk), r"(?s)WikiProject.*?class.*?=(.*?)(?:\||\}\}|\z)", 1)))
    return F.when(v.isin(*QUALITY_LIST), v).otherwise(F.lit("unknown"))


def extract_importance(talk) -> Column:
    """Mean importance over the ``WikiProject`` templates (one value per template
    segment), rounded half up; 'unknown' when none is rated."""
    levels = F.array(*[F.lit(x) for x in IMPORTANCE_LIST])
    segs = F.slice(F.split(_c(talk), "WikiProject", -1), 2, 1 << 30)
    idx = F.transform(segs, lambda s: F.array_position(
        levels, F.lower(wtrim(F.regexp_extract(s, r"(?s)importance.*?=(.*?)(?:\||\}\}|\z)", 1)))) - 1)
    rated = F.filter(idx, lambda i: i >= 0)
    mean = F.aggregate(rated, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(rated)
    return F.when(F.size(rated) == 0, F.lit("unknown")).otherwise(
        F.element_at(levels, (F.floor(mean + F.lit(0.5)) + 1).cast("int")))


# -------------------------------------------------------- nested removal

_NESTED_CACHE: dict = {}


def _nested_remover(open_tag: str, close_tag: str, anchor: str):
    key = (open_tag, close_tag, anchor)
    if key in _NESTED_CACHE:
        return _NESTED_CACHE[key]
    tok = re.compile("|".join(re.escape(t) for t in {open_tag, close_tag}))
    anc = re.compile(re.escape(anchor))

    def strip(text):
        if text is None or anchor not in text:
            return text
        out = []
        pos = 0
        while True:
            m = anc.search(text, pos)
            if m is None:
                out.append(text[pos:])
                return "".join(out)
            out.append(text[pos:m.start()])
            depth = 1
            end = None
            for t in tok.finditer(text, m.start() + len(open_tag)):
                depth += 1 if t.group() == open_tag else -1
                if depth == 0:
                    end = t.end()
                    break
            if end is None:               # unclosed: erase to the end
                return "".join(out)
            pos = end

    _NESTED_CACHE[key] = (by_text(strip), strip)
    return _NESTED_CACHE[key]


def remove_nested(c, open_tag: str, close_tag: str, anchor: str | None = None) -> Column:
    """Balanced removal of ``anchor``-opened regions: ``{{ a {{ b }} c }}`` goes
    whole, however deep.  An unclosed region erases the rest of the text."""
    udf, _ = _nested_remover(open_tag, close_tag, anchor or open_tag)
    c = _c(c)
    has = c.contains(anchor or open_tag)
    return F.when(has, udf(F.when(has, c))).otherwise(c)


def remove_nested_py(text: str, open_tag: str, close_tag: str, anchor: str | None = None) -> str:
    """The same removal on one Python string (for tests)."""
    _, strip = _nested_remover(open_tag, close_tag, anchor or open_tag)
    return strip(text)


def remove_templates_and_links(c) -> Column:
    """Templates, category links, web links, file links and image links removed, in this order.

    One Python step for all five, since every further one is a further worker per task;
    only texts with a template, file or image go through it."""
    c = _c(c)
    between = [("[[Category:", "]]"), ("[http://", "]")]
    plain = c
    for tags in between:
        plain = remove_between(plain, *tags)
    nested = [("{{", "}}", "{{"), ("[[", "]]", "[[File:"), ("[[", "]]", "[[Image:")]
    templates, files, images = (_nested_remover(*x)[1] for x in nested)
    links = [re.compile(f"(?s){re.escape(a)}.*?{re.escape(b)}") for a, b in between]

    def strip(text: str) -> str:
        text = templates(text)
        for link in links:
            text = link.sub("", text)
        return images(files(text))

    # a removed link can join the halves of a file's or an image's opening
    has = c.contains("{{") | plain.contains("[[File:") | plain.contains("[[Image:")
    return F.when(has, by_text(strip)(F.when(has, c))).otherwise(plain)


# ------------------------------------------------------------ text clean-up

# HTML-like blocks removed from article text, in this order,
# with their closing forms.
HTML_BLOCKS = [
    ("<ref", ["/ref>", "/>"]),
    ("<references", ["/references>", "/ref>", "/>"]),
    ("<nowiki", ["/nowiki>", "/>"]),
    ("<math", ["/math>", "/>"]),
    ("<gallery", ["/gallery>", "/>"]),
    ("<hiddentext", ["/hiddentext>", "/>"]),
    ("<div", ["/div>", "/>"]),
    ("<sub", ["/sub>", "/>"]),
    ("<sup", ["/sup>", "/>"]),
    ("<blockquote", ["/blockquote>", "/>"]),
    ("<references", ["/references>", "/>"]),
    ("<gallery", ["/gallery>", "/>"]),
    ("<small", ["/small>", "/>"]),
    ("<code", ["/code>", "/>"]),
    ("<big", ["/big>", "/>"]),
    ("<source", ["/source>", "/>"]),
]


def remove_html(c) -> Column:
    c = _c(c)
    for tag, ends in HTML_BLOCKS:
        c = remove_between(c, tag, ends)
    return c


def clean_text(c, truncate_at_bullet: bool = False, nested: bool = True) -> Column:
    """Article text without markup, following the ordered clean-up steps.

    ``truncate_at_bullet`` gives up everything from the first ``*`` on.
    ``nested=False`` skips the three balanced removals (templates, file and
    image links) -- for texts known to hold no ``{{`` or ``[[``.
    """
    t = decode_entities(c)
    if nested:
        t = remove_templates_and_links(t)
    else:
        t = remove_between(t, "[[Category:", "]]")
        t = remove_between(t, "[http://", "]")
    t = remove_between(t, "{|", "}")
    t = remove_between(t, "<!--", "-->")
    t = remove_html(t)
    t = remove_target(t, "'''")
    t = remove_between(t, "==", "==")
    t = remove_between(t, "===", "===")
    t = F.regexp_replace(t, " {2,}", " ")
    t = remove_target(t, '"')
    t = remove_target(t, "''")
    t = remove_target(t, "&")
    t = F.regexp_replace(t, r"\.{2,}", ".")
    t = F.replace(t, F.lit("="), F.lit(" "))
    if truncate_at_bullet:
        t = F.substring_index(t, "*", 1)
    t = remove_target(t, "#")
    t = remove_between(t, "(;", ")")
    t = remove_target(t, "—")
    t = remove_target(t, "()")
    t = F.replace(t, F.lit("."), F.lit(". "))
    t = F.regexp_replace(t, r"\.   ", ".  ")
    t = F.regexp_replace(t, r"\[\[[^\[\]]*\|", "")   # link target up to its last '|'

    t = remove_target(t, "]]")
    t = remove_target(t, "[[")
    t = remove_target(t, "\n")
    t = remove_target(t, "\\")
    t = remove_target(t, "\t")
    return wtrim(t)
