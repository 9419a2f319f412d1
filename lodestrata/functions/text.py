"""String functions: paths, source text, labels, markup."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_tokens = re.compile("[a-z0-9]+")


def normalize_path(path: Column) -> Column:
    """Slashes forward, white space stripped, doubled and dot segments collapsed, no leading or final slash."""
    p = F.trim(F.regexp_replace(path, r"\\", "/"))
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"(?:^|(?<=/))(?:\./)+", "")
    p = F.regexp_replace(p, r"/\.$", "")
    return F.regexp_replace(p, r"^/+|/+$", "")


def path_components(path: Column) -> Column:
    """The non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_prefixes(path: Column) -> Column:
    """The empty root and every prefix of a path, by length."""
    parts = path_components(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normalize_source(text: Column) -> Column:
    """Line ends to LF, blanks at line ends and empty lines at the end removed, one final line end."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(lf, r"[ \t]+(?=\n|$)", ""), r"\n+$", ""), F.lit("\n"))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def subtokens(label: Column) -> Column:
    """Parts of a label between bars; the whole label where there are none."""
    parts = F.filter(F.split(label, r"\|"), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(label))


def normalize_token(token: Column) -> Column:
    """White space collapsed; identifiers stay whole, numbers become one token, others over 32 characters are cut and end in dots."""
    t = collapse_space(token)
    name, number = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$", r"^(\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)$"
    return F.when(t.rlike(name), t).when(t.rlike(number), "NUMBER").when(F.length(t) > 32, F.concat(F.substring(t, 1, 31), F.lit("..."))).otherwise(t)


def token_shingles(text: Column, width: int) -> Column:
    """Distinct runs of width tokens of a whole text, in one pass over it."""

    @F.pandas_udf("array<string>")
    def runs(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = _tokens.findall((t or "").lower())
            out.append(list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))))
        return pd.Series(out, dtype=object)

    return runs(text)


#: What a page does not show: comments, the elements of scripts and styles (to their end tag, or to the page's), and tags.
_unseen = re.compile(r"""<!--.*?(?:-->|\Z) | <(?P<element>script|style)(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=element)\s*+>|\Z)|\Z) | <[a-z/!?](?:"[^"]*+"|'[^']*+'|[^"'>])*+> | <[a-z/!?][^>]*+(?:>|\Z)""", re.IGNORECASE | re.DOTALL | re.VERBOSE)


def visible(markup: str | None) -> str:
    """Text between what _unseen matches, with references resolved; in NFKC, case folded, white space collapsed."""
    shown = html.unescape(_unseen.sub(" ", markup or ""))
    return " ".join(unicodedata.normalize("NFKC", shown).casefold().split())


def html_visible_text(markup: Column) -> Column:
    """What a page shows, in NFKC, case folded, white space collapsed; scripts and styles are left out. Null gives empty."""

    @F.pandas_udf("string")
    def shown(pages: pd.Series) -> pd.Series:
        return pages.map(visible)

    return shown(markup)


#: File names without a dot that are of source trees, and what a path is made of.
BARE_NAMES = ("Makefile", "Dockerfile", "CMakeLists.txt")
PATH_TOKEN = r"((?:(?:a|b)/)?[A-Za-z0-9_.@+-]+(?:/[A-Za-z0-9_.@+-]+)+)"


def extract_paths(text: Column) -> Column:
    """Distinct sorted source paths in free text, without the a/ and b/ of diffs.

    A path has a slash, and its last part a dot or one of BARE_NAMES; what lies in .git and dev/null are left out.
    """
    found = F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(1))
    found = F.transform(found, lambda p: normalize_path(F.regexp_replace(p, "^[ab]/", "")))
    return F.array_sort(F.array_distinct(F.filter(found, is_source_path)))


def is_source_path(path: Column) -> Column:
    """Whether a normal path names a file of a source tree, by its last part."""
    name = F.element_at(F.split(path, "/"), -1)
    return (path != "") & (path != "dev/null") & ~path.contains("://") & ~path.startswith(".git/") & (name.isin(*BARE_NAMES) | name.contains("."))


def is_safe_path(path: Column) -> Column:
    """Whether a relative path stays below the folder that it is taken from: not empty, not absolute, no part that goes up."""
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def code2vec_contexts(line: Column) -> Column:
    """label and contexts (start, path, end) of a line of path contexts.

    Contexts without three fields, an end or any node of a path are dropped, and so are empty nodes.
    """
    parts = F.split(F.trim(line), r"\s+")
    triples = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.split(c, ","))
    three = F.filter(triples, lambda t: F.size(t) == 3)
    contexts = F.transform(three, lambda t: F.struct(t[0].alias("start"), F.filter(F.split(t[1], r"\|"), lambda x: x != "").alias("path"), t[2].alias("end")))
    contexts = F.filter(contexts, lambda c: (c["start"] != "") & (c["end"] != "") & (F.size(c["path"]) > 0))
    return F.struct(parts[0].alias("label"), contexts.alias("contexts"))
