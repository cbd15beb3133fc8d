"""Full-text search: BM25 over prefix phrases, structural re-ranking, at most so many hits a path.

A search reads each text once and shuffles nothing but its sums: term counts are
computed inside the row, the collection's statistics are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.75
CANDIDATES, PER_PATH = 400, 3


def clamp_limit(limit: int) -> int:
    return min(max(limit, 1), 100)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: the optimizer copies no expression through a generator, neither into filters nor into lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def phrase_frequency(words: Column, phrase: list[str]) -> Column:
    """Places where the words stand one after the other, the last one as a prefix. words: a string, a space before each word."""
    if len(phrase) == 1:  # a space can't overlap the letters, so taking out all places counts them
        return ((F.length(words) - F.length(F.replace(words, F.lit(f" {phrase[0]}"), F.lit("")))) / (len(phrase[0]) + 1)).cast("int")
    first, rest = phrase[0], " ".join(phrase[1:])
    return F.regexp_count(words, F.lit(f" {first}(?= {rest})"))


def word_count(words: Column) -> Column:
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))


def bm25(docs: DataFrame, words: Column, phrases: list[list[str]]) -> DataFrame:
    """docs with score (higher is nearer) for those with a match.

    words: a string with a space before each word (text.spaced_words); phrases: lists of words of letters, digits and marks that a pattern takes as they are.
    No phrases: no rows. A text is split into words once for the scores and once for the collection's statistics; time is linear in its length.
    """
    if not phrases:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    n = range(len(phrases))
    w = F.col("_words")
    counts = F.struct(word_count(w).alias("d"), *(phrase_frequency(w, p).alias(f"f{k}") for k, p in enumerate(phrases)))
    counted = once(once(docs, "_words", words), "_counts", counts).drop("_words")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_counts.d").alias("_avg"), *(F.count_if(F.col(f"_counts.f{k}") > 0).alias(f"_n{k}") for k in n))
    hits = counted.where(reduce(Column.__or__, (F.col(f"_counts.f{k}") > 0 for k in n)))
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in n:
        f, seen = F.col(f"_counts.f{k}"), F.col(f"_n{k}")
        idf = F.log((F.col("_n") - seen + 0.5) / (seen + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_counts.d") / F.col("_avg")))
    return joined.withColumn("score", score).drop("_counts", "_n", "_avg", *(f"_n{k}" for k in n))


def candidates(scored: DataFrame, key: list[str], most: int = CANDIDATES) -> DataFrame:
    return scored.orderBy(F.desc(F.round("score", 9)), *key).limit(most)


def share_in(parts: Column, terms: list[str]) -> Column:
    """The part of the distinct values that are among the terms; 0 without any."""
    parts = F.array_distinct(parts)
    return F.when(F.size(parts) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(parts, F.array(*map(F.lit, terms)))) / F.size(parts))


def rerank(hits: DataFrame, terms: list[str], symbol: Column, qualified: Column, path: Column, keywords: Column, file_class: Column) -> DataFrame:
    """hits with total: BM25 plus weights for symbol, qualified name, path and keywords, times a factor of the file's class.

    symbol, path and keywords: arrays of parts; qualified: a string.
    """
    all_terms = F.array(*map(F.lit, terms))
    exact = F.array_contains(all_terms, F.array_join(symbol, "_")) | F.array_contains(all_terms, F.array_join(symbol, ""))
    named = F.when(exact, F.lit(4.0)).otherwise(4.0 * share_in(symbol, terms))
    inside = F.when(F.exists(all_terms, lambda t: F.contains(F.lower(qualified), t)), F.lit(1.5)).otherwise(F.lit(0.0))
    total = F.col("score") + named + inside + 1.2 * share_in(path, terms) + F.size(F.array_intersect(keywords, all_terms))
    factor = F.when(file_class.startswith("test"), 0.8).when(file_class.isin("documentation", "architecture"), 0.7).otherwise(1.0)
    return hits.withColumn("total", F.round(total * factor, 6))


def diversify(hits: DataFrame, path: str, key: list[str], limit: int, per_path: int = PER_PATH) -> DataFrame:
    """The best hits, at most per_path of a path before the surplus of any path."""
    at = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("total"), *key))
    ranked = hits.withColumn("in_path", at).where(F.col("in_path") <= max(clamp_limit(limit), per_path))  # no path gives more
    return ranked.orderBy(F.col("in_path") > per_path, F.desc("total"), *key).limit(clamp_limit(limit))


def raw_scores(docs: DataFrame, text: str, terms: list[str], phrase: str) -> DataFrame:
    """Substring search: .7 coverage, .2 density up to 12 places, .1 for the whole phrase."""
    low = F.lower(text)
    count = lambda t: (F.length(low) - F.length(F.replace(low, F.lit(t)))) / len(t)
    found = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    places = sum((count(t) for t in terms), F.lit(0.0))
    score = 0.7 * found / len(terms) + 0.2 * F.least(F.lit(1.0), places / 12) + F.when(F.contains(low, F.lit(phrase)), 0.1).otherwise(0.0)
    return docs.withColumn("score", F.round(score, 6)).where(found > 0)


def regex_scores(lines: DataFrame, key: str, line: str, text: str, terms: list[str], class_weight: Column, defines: Column, near: int = 4) -> DataFrame:
    """Line search: .55 coverage, .20 nearness (distinct terms within so many lines), .10 rows up to 20, .10 class, .05 definitions."""
    hits = lines.withColumn("_t", F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))).where(F.size("_t") > 0)
    around = Window.partitionBy(key).orderBy(line).rangeBetween(-near, near)
    rows = hits.withColumn("_near", F.size(F.array_distinct(F.flatten(F.collect_list("_t").over(around))))).withColumn("_class", class_weight).withColumn("_def", defines)
    n = len(terms)
    of = rows.groupBy(key).agg(F.size(F.array_distinct(F.flatten(F.collect_set("_t")))).alias("cover"), F.max("_near").alias("near"), F.count(F.lit(1)).alias("rows"), F.max("_class").alias("class"), F.max(F.col("_def").cast("int")).alias("defined"))
    score = 0.55 * F.col("cover") / n + 0.20 * F.col("near") / n + 0.10 * F.least(F.lit(1.0), F.col("rows") / 20) + 0.10 * F.col("class") + 0.05 * F.col("defined")
    return of.select(key, "cover", "near", "rows", F.round(score, 6).alias("score"))


def tag_scores(tags: DataFrame, parts: Column, signature: Column, kind_weight: Column, exact: Column, terms: list[str]) -> DataFrame:
    """Tag search: .55 coverage (half for prefixes), .15 signature, .20 kind, .30 exact name."""
    whole = F.array(*map(F.lit, terms))
    hit = lambda t: F.when(F.array_contains(parts, t), F.lit(1.0)).when(F.exists(parts, lambda p: p.startswith(t)), F.lit(0.5)).otherwise(F.lit(0.0))
    cover = F.aggregate(whole, F.lit(0.0), lambda s, t: s + hit(t)) / len(terms)
    signed = F.size(F.filter(whole, lambda t: F.contains(F.lower(signature), t))) / len(terms)
    score = 0.55 * cover + 0.15 * signed + 0.20 * kind_weight + F.when(exact, 0.30).otherwise(0.0)
    return tags.withColumn("cover", cover).where(F.col("cover") > 0).withColumn("score", F.round(score, 6))


def syntax_scores(symbols: DataFrame, parts: Column, signature: Column, kind_weight: Column, exact: Column, is_test: Column, terms: list[str]) -> DataFrame:
    """Syntax-tree search: .50 coverage, .15 signature, .15 kind, .30 exact name; six tenths of it in tests."""
    whole = F.array(*map(F.lit, terms))
    cover = F.size(F.array_intersect(F.array_distinct(parts), whole)) / len(terms)
    signed = F.size(F.filter(whole, lambda t: F.contains(F.lower(signature), t))) / len(terms)
    score = 0.50 * cover + 0.15 * signed + 0.15 * kind_weight + F.when(exact, 0.30).otherwise(0.0)
    return symbols.withColumn("cover", cover).where(F.col("cover") > 0).withColumn("score", F.round(score * F.when(is_test, 0.6).otherwise(1.0), 6))


def docs_scores(lines: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Documentation search: .7 coverage, .3 rows up to 8."""
    hits = lines.withColumn("_t", F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))).where(F.size("_t") > 0)
    of = hits.groupBy(key).agg(F.size(F.array_distinct(F.flatten(F.collect_set("_t")))).alias("cover"), F.count(F.lit(1)).alias("rows"))
    return of.withColumn("score", F.round(0.7 * F.col("cover") / len(terms) + 0.3 * F.least(F.lit(1.0), F.col("rows") / 8), 6))
