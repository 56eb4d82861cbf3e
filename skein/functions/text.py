"""Text, path and identifier expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGE_EXTENSIONS = {
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "rust": ["rs"],
    "go": ["go"],
    "java": ["java"],
    "markdown": ["md", "mdx"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
}
#: Base names that make a file important, in lower case.
IMPORTANT_NAMES = ["package.json", "tsconfig.json", "index.ts", "index.js", "main.ts", "main.js"]

_WHITE = r"[\s ﻿\p{Zs}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    """Without any white space at either end, the non-breaking kinds included."""
    return F.regexp_replace(text, rf"^{_WHITE}+|{_WHITE}+$", "")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("long")


def query_tokens(query: str) -> list[str]:
    """Lower-cased pieces between runs of white space; white space at the ends leaves empty tokens."""
    import re

    return re.split(r"\s+", query.lower())


def whole_word(text: Column, token: str) -> Column:
    """Does ``token`` stand in ``text`` between ASCII word boundaries?"""
    return text.rlike(rf"(?<![A-Za-z0-9_]){token}(?![A-Za-z0-9_])") if token else text.rlike("[A-Za-z0-9_]")


def relevance(text: Column, path: Column, query: str) -> Column:
    """0.1 for each token found, 0.3 more where it is a whole word, 0.1 for TypeScript files; 1 at most."""
    low = F.lower(text)
    # a whole word is only looked for where its letters stand
    parts = [F.when(~low.contains(t), 0.0).when(whole_word(low, t), 0.1 + 0.3).otherwise(0.1) for t in query_tokens(query)]
    parts.append(F.when(path.endswith(".ts") | path.endswith(".tsx"), 0.1).otherwise(0.0))
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0))


def hybrid_score(vector: Column, symbol: Column, vector_weight: float = 0.4, symbol_weight: float = 0.6) -> Column:
    return vector * vector_weight + symbol * symbol_weight


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name; none for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def is_excluded(path: Column, excludes: list[str]) -> Column:
    """``name/`` leaves out a folder at any depth, ``name`` a file or folder of that name."""
    tests = []
    for x in excludes:
        tests.append(path.startswith(x) | path.contains("/" + x) if x.endswith("/") else (path == x) | path.endswith("/" + x))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def importance(path: Column) -> Column:
    """Points for the language, the place and the name of a file."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    ends = lambda *ext: reduce(lambda a, b: a | b, [path.endswith(e) for e in ext])
    kind = F.when(ends(".ts", ".tsx"), 10).when(ends(".js", ".jsx"), 8).when(ends(".json"), 5).otherwise(0)
    return kind + F.when(slashes == 0, 5).otherwise(0) + F.when(F.lower(basename(path)).isin(IMPORTANT_NAMES), 15).otherwise(0) + F.greatest(F.lit(0), 10 - slashes)


def short_id(path: Column) -> Column:
    """First 16 characters of the path's base64 without its three signs."""
    return F.substring(F.regexp_replace(F.base64(F.encode(path, "UTF-8")), "[/+=\r\n]", ""), 1, 16)


def preview(text: Column, size: int = 100) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def whole_words(pattern: str) -> str:
    """A pattern for whole words, bounded as if only ASCII letters, digits and the underscore made words."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


#: Words that tell how hard a question is, and what it is about; the first that fits counts.
HARD, HARDER = r"how|explain|design|describe", r"why|analyze|compare|evaluate|trade-?offs?"
INTENTS = {"callgraph": r"calls?|callers?|called|invokes?", "import": r"imports?|depends?|dependency|dependencies", "file": r"files?|where|path"}


def question_class(question: Column) -> Column:
    """complex, medium or simple, by the hardest word asked with."""
    low = F.lower(question)
    return F.when(low.rlike(whole_words(HARDER)), "complex").when(low.rlike(whole_words(HARD)), "medium").otherwise("simple")


def question_intent(question: Column) -> Column:
    low, out = F.lower(question), F.lit("symbol")
    for name, words in reversed(INTENTS.items()):
        out = F.when(low.rlike(whole_words(words)), name).otherwise(out)
    return out


def clean_code(text: Column) -> Column:
    """Without comments and doc strings, white space collapsed."""
    bare = F.regexp_replace(text, r'(?s)""".*?"""|/\*.*?\*/', " ")
    bare = F.regexp_replace(bare, r"(?m)(#|//).*$", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def rounded_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
