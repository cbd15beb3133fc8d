"""Words, identifiers, paths and token counts as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = ("the", "and", "for", "that", "this", "with", "from", "are", "was", "not", "but", "you", "all", "can", "has", "have", "will", "into", "its", "our", "out", "use", "any", "per", "via")
NOISE_NAMES = ("if", "for", "while", "switch", "catch", "return", "else", "elif", "try", "with", "new", "do", "case", "throw", "match", "loop")


def text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_words(value: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text(value)), "[^a-z0-9]+"), lambda w: w != "")


def spaced_words(value: Column | str) -> Column:
    """The same words as one string, a space before each."""
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), F.lower(text(value))), "[^a-z0-9]+", " "))


def unicode_words(value: Column | str) -> Column:
    """Runs of letters and digits, lower case, accents kept."""
    return F.filter(F.split(F.lower(text(value)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_identifier(value: Column | str) -> Column:
    """Parts of a camel-case, snake-case or dashed name, as written."""
    return F.regexp_extract_all(text(value), F.lit("([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"), F.lit(1))


def query_terms(value: Column | str, least: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Ordered distinct words of a question with the parts of its identifiers, lower case; no numbers, stop words or short ones."""
    words = F.filter(F.split(text(value), "[^A-Za-z0-9_]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.transform(split_identifier(w), F.lower)))
    kept = F.filter(F.flatten(each), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop))
    return F.array_distinct(kept)


def stem(value: Column) -> Column:
    """Cuts the first of -ing, -ers, -ed, -es, -s that leaves more than two characters."""
    out = value
    for end in ("s", "es", "ed", "ers", "ing"):
        out = F.when(value.endswith(end) & (F.length(value) > len(end) + 2), F.substring(value, F.lit(1), F.length(value) - len(end))).otherwise(out)
    return out


def identifier_variants(words: Column) -> Column:
    """connection pool: connection_pool, connectionPool, ConnectionPool."""
    low = F.transform(words, F.lower)
    caps = F.array_join(F.transform(low, F.initcap), "")
    camel = F.concat(F.lower(F.substring(caps, 1, 1)), caps.substr(F.lit(2), F.length(caps)))
    return F.array_distinct(F.array(F.array_join(low, "_"), camel, caps))


def is_term(term: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Whether a trimmed lower-case word can be a keyword."""
    return F.length(term).between(3, 40) & ~term.rlike("^[0-9]+$") & ~term.isin(*stop)


def normalize_term(term: Column) -> Column:
    return F.regexp_replace(F.lower(term), r"^[_\-.:]+|[_\-.:]+$", "")


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading ./, no empty or single-dot steps."""
    steps = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.array_join(steps, "/")


def normalize_symbol(symbol: Column) -> Column:
    """Scope marks become dots; dots at the ends go."""
    return F.regexp_replace(F.regexp_replace(symbol, "::|#", "."), r"^\.+|\.+$", "")


def dotted_suffixes(symbol: Column) -> Column:
    """a.b.c: a.b.c, b.c, c. With these a suffix join becomes an equi-join."""
    parts = F.split(symbol, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))


def path_suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def names_match(asked: Column, name: Column, qualified: Column) -> Column:
    """Bare or qualified, any case."""
    low = F.lower(asked)
    return (F.lower(name) == low) | (F.lower(qualified) == low) | F.lower(qualified).endswith(F.concat(F.lit("."), low))


def module_name(path: Column) -> Column:
    """pkg/mod.py: pkg.mod; pkg/__init__.py: pkg; leading src or lib goes."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    return F.regexp_replace(F.regexp_replace(plain, "^(src|lib)/", ""), "/", ".")


def absolute_module(module: Column, level: Column, importer: Column) -> Column:
    """from ..x import y in a.b.c: a.x. importer: the importing module's package, dotted."""
    parts = F.split(importer, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + 1, F.lit(0))), ".")
    return F.when(level == 0, module).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit(""))))


def module_candidates(module: Column) -> Column:
    path = F.regexp_replace(module, r"\.", "/")
    return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(path, F.lit(".pyi")))


def visibility(name: Column) -> Column:
    return F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "internal").otherwise("public")


def language_of(path: Column, extensions: dict[str, str]) -> Column:
    named = F.create_map(*(F.lit(x) for pair in extensions.items() for x in pair))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(path.rlike("(^|/)(Makefile|Dockerfile)$"), "text").otherwise(F.coalesce(F.try_element_at(named, suffix), F.lit("unknown")))


def candidate_tokens(value: Column) -> Column:
    """A candidate's own estimate of tokens: 0.27 a character."""
    return F.greatest(F.lit(1), F.floor(F.length(value) * F.lit(0.27)).cast("int") + 1)


def quarter_tokens(value: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(value) / 4).cast("int")


def word_tokens(value: Column) -> Column:
    """Words of up to four characters count one, longer ones a quarter of their length; marks and line ends one each."""
    parts = F.regexp_extract_all(value, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), F.lit(1))
    lines = F.length(value) - F.length(F.replace(value, F.lit("\n")))
    return (F.aggregate(parts, F.lit(0), lambda s, p: s + F.when(F.length(p) <= 4, 1).otherwise(F.ceil(F.length(p) / 4).cast("int"))) + lines).cast("int")


def canonical_json(*columns: str) -> Column:
    """Keys in order, nulls kept, no spaces."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def structure_hash(value: Column) -> Column:
    """SHA-256 of the lines with white space collapsed and empty lines left out."""
    lines = F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.sha2(F.array_join(F.filter(lines, lambda x: x != ""), "\x1e"), 256)
