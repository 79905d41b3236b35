"""Texts shown to users: templates, lookups with a fallback, and stored reasons in words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = r"\{(\w+)\}"
FALLBACK = "zh"


def plural(n: Column) -> dict[str, Column]:
    """The endings that follow a number in English templates: s, es and are."""
    single = F.coalesce(n.cast("string").try_cast("double") == 1, F.lit(False))
    return {"s": F.when(single, "").otherwise("s"), "es": F.when(single, "").otherwise("es"), "are": F.when(single, "is").otherwise("are")}


def filled(template: Column, **values: Column) -> Column:
    """The template with every {name} that has a value replaced by it, others left as they stand; a number n brings its plural along.

    Values aren't read as templates again. A null value reads as nothing.
    """
    known = (plural(values["n"]) if "n" in values else {}) | values
    named = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit(""))))) if known else F.create_map().cast("map<string,string>")
    between, slots = F.split(template, SLOT), F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))
    shown = F.transform(slots, lambda k: F.coalesce(F.try_element_at(named, k), F.concat(F.lit("{"), k, F.lit("}"))))
    return F.array_join(F.zip_with(between, shown, lambda text, value: F.concat(text, F.coalesce(value, F.lit("")))), "")


def said(key: Column, tables: Mapping[str, Mapping[str, str]], lang: Column, **values: Column) -> Column:
    """The text of a key in the row's language, else in the fallback, else the key itself, filled in."""
    words = F.create_map(*(F.lit(x) for code, own in tables.items() for k, text in own.items() for x in (f"{code}/{k}", text)))
    in_ = lambda code: F.try_element_at(words, F.concat(code, F.lit("/"), key))
    return filled(F.coalesce(in_(lang), in_(F.lit(FALLBACK)), key), **values)


#: Stored reasons with a part of their own: pattern, key, name of the part. The patterns are fixed by what is stored.
PATTERNS = (("^最像「(.*)」但不夠確定$", "closest", "cat"), ("^與 (.*) 完全相同$", "same_as", "name"), ("^類別「(.*)」已刪除$", "cat_deleted", "cat"))


def reason(code: Column, words: Mapping[str, str], templates: Mapping[str, str]) -> Column:
    """A stored reason in words: ``words`` by exact code, ``templates`` by the keys of PATTERNS with {part}; others stay as they are."""
    out = code
    for pattern, key, part in reversed(PATTERNS):
        before, _, after = templates.get(key, "{%s}" % part).partition("{%s}" % part)
        out = F.when(code.rlike(pattern), F.concat(F.lit(before), F.regexp_extract(code, pattern, 1), F.lit(after))).otherwise(out)
    for exact, text in words.items():
        out = F.when(code == exact, text).otherwise(out)
    return out


def relative(path: Column, root: str) -> Column:
    """The path below the library's root; others stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def batch_id(at: Column, session: Column) -> Column:
    """A batch's id: when it began, and the first six characters of its session."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(session, 1, 6))
